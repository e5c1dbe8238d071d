"""Fill-in-middle transformation against a plain version."""

import hashlib
import re

import pytest

from placequery.llm import infilling

COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_version(doc_id, text, rate=100, spm_rate=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    digits = sha(f"7:{'' if doc_id is None else doc_id}")
    h = [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, n, "plain", None, None, text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(p) for p in (units[:low], units[low:high], units[high:]))
    spm = h[3] % 100 < spm_rate
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), out)


TEXTS = [
    "", None, "one", "one\n", "\n", "\n\n\n", "a\nb\nc\nd", "é\nßü\n\U0001f600 x\nlast", "has <M> inside\nx", "<P", "tab\r\nline\x0bx\x0c\n",
    "x" * 300_000, "y\n" * 200_000, "\n".join("lä" * (k % 500) for k in range(3000)),
]
ROWS = [(k * 31 + r, t) for r in range(6) for k, t in enumerate(TEXTS)] + [(None, "null id\nrow"), (None, "null id\nother"), (7, "twice\na"), (7, "twice\na"), (7, "third\nb\nc")]


def key(row):
    return tuple(str(v) for v in row)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, place int, mark string, digest string")


@pytest.mark.parametrize(("rate", "spm_rate"), [(100, 50), (40, 90)])
def test_digests_and_outputs(spark, monkeypatch, rate, spm_rate):
    docs = docs_of(spark, ROWS).repartition(5)
    expected = sorted((plain_version(i, t, rate, spm_rate) + (sha(t or ""),) for i, t in ROWS), key=key)
    found = sorted((tuple(r[c] for c in COLUMNS) for r in infilling.digests(docs, rate=rate, spm_rate=spm_rate).collect()), key=key)
    assert found == sorted(((*e[:5], sha(e[5]), e[6]) for e in expected), key=key)
    rows = infilling.outputs(docs, rate=rate, spm_rate=spm_rate).collect()
    assert sorted((tuple(r) for r in rows), key=key) == sorted((e[:6] for e in expected), key=key)
    assert sorted(sha(infilling.restored(r["output"], r["form"])) for r in rows) == sorted(sha(t or "") for _, t in ROWS)


def test_no_rows(spark):
    docs = docs_of(spark, [])
    assert infilling.digests(docs).collect() == [] and infilling.digests(docs).columns == COLUMNS


def test_chunks_are_bounded(spark):
    sizes = [len(r["chunk"]) for r in infilling.pieces(docs_of(spark, ROWS)).collect()]
    assert max(sizes) <= infilling.CHUNK_BYTES and len(sizes) > len(ROWS) * 2


def test_copies_are_sent_once_a_batch(spark):
    docs = docs_of(spark, [(5, "same\ntext\n")] * 3000)
    assert infilling.pieces(docs).count() < 100
    assert infilling.digests(docs).count() == 3000
