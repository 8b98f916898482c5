"""Secret scan: random strings of every alphabet, alone and inside longer runs; names stay."""

import random
import string

import pytest

from tallyspark.llm import secrets

SPANS = secrets.scanner(secrets.BPE_RANKS, secrets.MAX_CHARS_PER_TOKEN)
RANDOM = random.Random(7)
ALPHABETS = {
    "base32": (string.ascii_uppercase + "234567", 0.97),
    "base36 lower": (string.ascii_lowercase + string.digits, 0.95),
    "base36 upper": (string.ascii_uppercase + string.digits, 0.97),
    "base62": (string.ascii_letters + string.digits, 0.97),
    "lower": (string.ascii_lowercase, 0.8),
    "upper": (string.ascii_uppercase, 0.92),
}


def dense(text):
    return [text[a:b] for a, k, b in SPANS(text) if k == 3]


@pytest.mark.parametrize("name", ALPHABETS)
@pytest.mark.parametrize("length", [16, 20, 40])
def test_random_strings_are_found_alone_and_inside_a_path(name, length):
    alphabet, least = ALPHABETS[name]
    strings = ["".join(RANDOM.choices(alphabet, k=length)) for _ in range(200)]
    assert sum(dense(f"see {s} now") == [s] for s in strings) >= least * 200
    assert sum(any(s in d for d in dense(f"src/main/resources/configuration/{s}/production_settings")) for s in strings) >= least * 200


def test_a_window_is_found_in_a_run_without_separators():
    covered = []
    for _ in range(200):
        s = "".join(RANDOM.choices(string.ascii_letters + string.digits + "+/", k=32))
        text = f"internationalization/configurationInternationalization{s}internationalization"
        at = text.index(s)
        covered.append(sum(max(0, min(b, at + 32) - max(a, at)) for a, b in ((a, b) for a, k, b in SPANS(text) if k == 3)))
    assert sum(c > 0 for c in covered) >= 196
    assert sum(c >= 24 for c in covered) >= 180


@pytest.mark.parametrize(
    "name",
    "2024-01-15T10-30-00Z ISO-8859-1/UTF-8-encoded getXMLHttpReqCfgPtrImpl Rechtsschutzversicherungsgesellschaften antidisestablishmentarianism"
    " /usr/share/doc/python3-numpy/examples kubernetes-ingress-nginx-controller x86_64-unknown-linux-gnu wp-content/uploads/2019/03/IMG_20190312_104532"
    " /files/D41D8CD98F00B204E9800998ECF8427E/x /a/123e4567-e89b-12d3-a456-426614174000/show abcdefghijklmnopqrstuvwxyz ==================== przedsiebiorstwa".split(),
)
def test_names_paths_and_digests_are_spared(name):
    assert dense(f"see {name} now") == []
