"""Secrets: the text's own finds against a plain definition, planted layers, and odd rows."""

import base64
import bz2
import gzip
import lzma
import random
import re
import zlib
from collections import Counter
from hashlib import sha256
from urllib.parse import quote

import pytest
import zstandard

from emberline.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def own_finds(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)


@pytest.fixture(params=["documents", "odd"])
def rows(request):
    return request.getfixturevalue(request.param)


def test_own_finds(table, rows):
    wanted = Counter()
    for doc_id, text in rows:
        found = own_finds(text or "")
        wanted[doc_id, *[sum(k == kind for _, k, _ in found) for kind in range(3)], sha256(joined(found).encode()).hexdigest()] += 1
    names = "doc_id", "n_assign", "n_access", "n_hex", "base_sha256"
    assert Counter(tuple(r) for r in secrets.secrets_digest(table(rows)).select(*names).collect()) == wanted


def test_patterns_on_made_texts():
    draw = random.Random(13)
    parts = ["password", "Token", "API_key", "ſecret", "=", ":", " ", '"', "'", "abcdef", "x", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef", "é", "\n", "-", "%41", "\\u0041"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randrange(12)))
        sure, added, complete = secrets.scan(text)
        assert sure == own_finds(text) and complete and not set(sure) & set(added)


SECRET = 'password = "hunter2222"'
LONG = " ".join(str(random.Random(1).random()) for _ in range(80)) + " " + SECRET


def b64(raw):
    return base64.b64encode(raw).decode()


FORMS = {
    "url": quote(SECRET),
    "url form": SECRET.replace(" ", "+").replace("=", "%3D"),
    "one escape": "p%61ssword=hunter2222",
    "url twice": quote(quote(SECRET)),
    "unicode": "".join(f"\\u{ord(c):04x}" for c in SECRET),
    "bytes": "".join(f"\\x{ord(c):02x}" for c in SECRET),
    "entities": "".join(f"&#{ord(c)};" for c in SECRET),
    "hex entities": "".join(f"&#x{ord(c):x};" for c in SECRET),
    "base64": b64(SECRET.encode()),
    "base64 for urls": base64.urlsafe_b64encode(b"???>>>" + SECRET.encode()).decode(),
    "base64 behind a path": "/opt/" + b64(SECRET.encode()),
    "base64 in lines": base64.encodebytes(LONG.encode()).decode().strip(),
    "base64 twice": b64(b64(SECRET.encode()).encode()),
    "base64 of url": b64(quote(SECRET).encode()),
    "url of base64": quote(b64(SECRET.encode() + b"?")),
    "gzip": b64(gzip.compress(LONG.encode())),
    "zlib": b64(zlib.compress(LONG.encode())),
    "bz2": b64(bz2.compress(LONG.encode())),
    "xz": b64(lzma.compress(LONG.encode())),
    "zstd": b64(zstandard.compress(LONG.encode())),
    "gzip in gzip": b64(gzip.compress(gzip.compress(LONG.encode()))),
    "url of gzip": quote(gzip.compress(LONG.encode())),
    "gzip of base64 of unicode": b64(gzip.compress(b64("".join(f"\\u{ord(c):04x}" for c in SECRET).encode()).encode())),
}


@pytest.mark.parametrize("form", FORMS)
def test_planted_layers_are_found(form):
    text = f"é before {FORMS[form]} after ü"
    sure, added, complete = secrets.scan(text)
    start, end = 9, 9 + len(FORMS[form])
    assert complete and any(k == 0 and start <= s and e <= end for s, k, e in added), added
    if "gzip" not in form and "lines" not in form:  # mapped to the encoded secret itself
        s, e = next((s, e) for s, k, e in added if k == 0)
        assert e - s >= len(FORMS[form]) * 0.6


def test_span_of_one_base64_layer():
    head = b"some harmless words "
    text = "ß " + b64(head + SECRET.encode() + b" and more words behind it")
    _, added, _ = secrets.scan(text)
    (start, _, end), = [s for s in added if s[1] == 0]
    assert base64.b64decode(text[2:])[len(head) :].startswith(SECRET.encode()[:-1])
    assert start == 2 + len(head) // 3 * 4 + len(head) % 3 and start < end < len(text)


def test_clean_texts_get_no_spans(documents):
    added = [a for _, text in documents for a in secrets.scan(text)[1]]
    assert len(added) <= 1
    for text in ("100% sure, 50%ef", "/usr/local/lib/python3/site-packages/numpy", "aHR0cHM6Ly9leGFtcGxlLm9yZy9pbmRleC5odG1s", "x^2 + y^2"):
        assert secrets.scan(text) == ([], [], True)


def test_cycles_and_repeats_end():
    opened = []

    def same(layer):  # an archive that unpacks to itself
        opened.append(layer.data)
        yield layer
        yield secrets.Layer(layer.data[::-1], layer.low[::-1], layer.high[::-1])

    assert secrets.scan("token: abcdefgh", decoders=(same,))[2] and len(opened) == 2


def test_archive_bomb_is_read_in_windows():
    bomb = b64(gzip.compress(b"a b " * 5_000_000 + SECRET.encode()))
    assert [k for _, k, _ in secrets.scan(bomb)[1]] == [0]
    sure, added, complete = secrets.scan("token=abcdef " + bomb, max_unpacked=1 << 20)
    assert len(sure) == 1 and not complete


def test_redact_keeps_rows_and_columns(spark, table, odd, empty):
    rows = odd + [(77, "x " + FORMS["gzip"] + " y"), (78, "token=abcdef, " + quote(SECRET))]
    frame = table(rows)
    out = secrets.redact(frame)
    assert out.columns == frame.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[77].startswith("x [assign]") and "hunter" not in texts[77] and len(texts[77]) < 200
    assert texts[78].startswith("[assign], [assign]")
    assert {(d, t) for d, t in texts.items() if d in (4, 9, 14)} == {(d, t) for d, t in odd if d in (4, 9, 14)}
    assert secrets.secrets_digest(empty).count() == 0 and secrets.redact(empty).count() == 0
    found = secrets.find_secrets(table(rows)).filter("doc_id = 78").first()
    assert [s.kind for s in found.sure] == ["assign"] and found.added and found.complete
