"""Secret scan by token efficiency.

Random strings cost many tokens for their length: a byte-pair vocabulary made
from ordinary text covers words with few tokens and random characters with
one token for each one or two characters. The scan takes every run of key
characters, leaves out known digests and identifiers, and reports runs whose
characters per token stay at or below a threshold (kind ``dense``). Of a run
that isn't reported whole, the parts between separators are tested in the same
way, and then windows of ``WINDOW`` characters: those that overlap are one
span, reported if one of them stays below a stricter threshold. Three plain patterns (kinds ``assign``,
``access``, ``hex``) always apply as well.

Defined results: a null or empty text has no span. Texts of any length are
scanned whole. Repeated rows are each scanned; extra columns pass through.
"""

from __future__ import annotations

import base64
import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import BPE_RANKS, text_struct

# The three base patterns and the lengths that a match must have.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs of 16 or more are what remains of all maximal runs
KINDS = ("assign", "access", "hex", "dense")
KEYWORDS = ("passw", "secret", "token", "api_key", "apikey")

RUN = r"[A-Za-z0-9+/_=-]{16,}"
PART = re.compile(r"[A-Za-z0-9]+")
DIGEST = re.compile(r"(?:(?:md5|sha1|sha224|sha256|sha384|sha512)[-_:=])?(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})|sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Digests without a name, and UUIDs, inside a run.
INSIDE = re.compile(r"(?<![A-Za-z0-9])(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?![A-Za-z0-9])")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")

#: Characters per token at or below which a run counts as random.
MAX_CHARS_PER_TOKEN = 1.9
#: Least characters of a window inside a run, and its characters per token, as a share of a run's.
WINDOW, STRICTER = 20, 0.85
#: A word has WORD_LETTERS letters or more, and so many for each of its tokens; parts up to SHORT_PART count as a name's.
WORD_LETTERS, SHORT_PART = 3, 5


def identifier(run: str, encode) -> bool:
    """Numbers, UUIDs, alphabets, and names of which three quarters are words, numbers and short parts.

    A word is told by its tokens, so letters alone make no word.
    """
    if not re.search("[A-Za-z]", run) or UUID.fullmatch(run):
        return True
    if sum(ord(b) - ord(a) == 1 for a, b in zip(run, run[1:])) >= 0.75 * len(run):
        return True
    told = len(run)
    for part in PART.findall(run):
        if len(part) <= SHORT_PART and len(part) < len(run) or part.isdigit():
            continue
        words = [w for w in WORDS.findall(part) if len(w) >= WORD_LETTERS and len(w) >= WORD_LETTERS * len(encode(w))]
        told -= len(part) - sum(map(len, words))
    return told >= 0.75 * len(run)


def load_encoder(ranks_file: str = BPE_RANKS, special_tokens: dict[str, int] | None = None):
    """The tiktoken encoder of a rank file of public_tokenizers."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(ranks_file), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special_tokens or {})


def scanner(ranks_file: str, threshold: float):
    """A function from a text to its spans (start, kind number, end), in order."""
    assign, access, hexes, runs = (re.compile(p) for p in (ASSIGN, ACCESS, HEX, RUN))
    encoder = load_encoder(ranks_file)
    encode = encoder.encode_ordinary

    def random(run: str, most: float) -> bool:
        return len(run) <= most * len(encode(run)) and not identifier(run, encode) and not DIGEST.fullmatch(run)

    def windows(run: str) -> list[tuple[int, int]]:
        """Where windows of WINDOW characters or more are random, as (start, end)."""
        at = [0]
        for token in encoder.decode_tokens_bytes(encode(run)):
            at.append(at[-1] + len(token))
        found, j = [], 0
        for i in range(len(at)):
            while j < len(at) and at[j] - at[i] < WINDOW:
                j += 1
            if j == len(at):
                break
            if at[j] - at[i] <= threshold * (j - i):
                if not found or at[i] > found[-1][1]:
                    found.append([at[i], at[j], False])
                found[-1][1] = at[j]
                found[-1][2] |= at[j] - at[i] <= STRICTER * threshold * (j - i)
        return [(a, b) for a, b, sure in found if sure and not identifier(run[a:b], encode)]

    def inside(run: str) -> list[tuple[int, int]]:
        """Random parts and windows of a run that isn't random as a whole."""
        found = [m.span() for m in PART.finditer(run) if len(m.group()) >= 16 and random(m.group(), threshold)]
        out, at = list(found), 0
        for a, b in [*found, (len(run), len(run))]:  # windows lie between the parts that are found
            out += [(at + x, at + y) for x, y in windows(run[at:a])]
            at = b
        return out

    def spans(text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        found, lower = [], text.lower()
        if any(k in lower for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in assign.finditer(text) if m.end(2) - m.start(2) >= 12]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in access.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in hexes.finditer(text)]
        base = list(found)
        for m in runs.finditer(text):
            run, a, b = m.group(), m.start(), m.end()
            if any(x <= a and b <= y for x, _, y in base) or DIGEST.fullmatch(run):
                continue
            known = [(a + d.start(), a + d.end()) for d in INSIDE.finditer(run)]
            if not known and random(run, threshold):
                found.append((a, 3, b))
                continue
            # What is left of the run without base spans, digests and UUIDs.
            at = a
            for x, y in [*sorted([(x, y) for x, _, y in base if x < b and y > a] + known), (b, b)]:
                if x - at >= 16:
                    found += [(at + s, 3, at + e) for s, e in inside(text[at:x])]
                at = max(at, y)
        return sorted(found)

    return spans


def secret_spans(docs: DataFrame, text: str = "text", out: str = "secrets", *, ranks_file: str = BPE_RANKS, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Add column ``out``: array of (kind, start, end), code points, end exclusive, in order."""

    def make():
        spans = scanner(ranks_file, max_chars_per_token)
        return lambda texts: {"spans": [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans(t)] for t in texts]}

    column = text_struct(make, "spans array<struct<kind:string,start:long,end:long>>")
    return docs.withColumn(out, column(F.col(text))["spans"])


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", *, ranks_file: str = BPE_RANKS, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """Replace every span by ``mark``, overlapping spans once; other text is kept as it is."""

    def make():
        spans = scanner(ranks_file, max_chars_per_token)

        def clean(t):
            out, at = [], 0
            for a, _, b in spans(t):
                if a >= at:
                    out += [t[at:a], mark]
                at = max(at, b)
            return t if not out else "".join(out) + t[at:]

        return lambda texts: {"text": [clean(t) for t in texts]}

    return docs.withColumn(text, text_struct(make, "text string")(F.col(text))["text"])


def secret_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts of the base kinds, the digest of the base spans, all spans."""

    def make():
        spans = scanner(BPE_RANKS, MAX_CHARS_PER_TOKEN)

        def batch(texts):
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_dense", "base_sha256", "spans")}
            for t in texts:
                found = spans(t)
                for k, n in enumerate(("n_assign", "n_access", "n_hex", "n_dense")):
                    out[n].append(sum(s[1] == k for s in found))
                said = [(k, f"{KINDS[k]}:{a}:{b}") for a, k, b in found]
                out["base_sha256"].append(hashlib.sha256(",".join(s for k, s in said if k < 3).encode()).hexdigest())
                out["spans"].append(",".join(s for _, s in said))
            return out

        return batch

    column = text_struct(make, "n_assign long, n_access long, n_hex long, n_dense long, base_sha256 string, spans string")
    return docs.select("doc_id", column(F.col("text")).alias("s")).select("doc_id", "s.*")
