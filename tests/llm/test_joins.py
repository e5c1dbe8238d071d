"""Joins, archives and URL filters against brute force."""

import random
import zipfile

import numpy as np
import pytest

import corpus_pipeline
from placequery.functions.storage import scratch_path
from placequery.llm import archives, bpe, decontamination, embedding_join, jaccard_join, quality, url_filters
from placequery.llm.components import components


def least_reachable(ids, links):
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def brute_classes(rows, percent, width):
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]]
    label = least_reachable(ids, links)
    return {(i, len(sets[i]), label[i]) for i in ids}


def near_texts(n, seed):
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(20, 120))] for _ in range(4)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"e{rnd.randint(0, 50)}"
        if i % 4 == 0:
            w = [f"r{rnd.randint(0, 9**6)}" for _ in range(rnd.randint(1, 30))] + [f"s{k}" for k in range(40)]
        rows.append((i, " ".join(w)))
    return [*rows, (n, None), (n + 1, " \n"), (n + 2, "Two words"), (n + 3, "two\tWORDS"), (n + 4, "É two"), (n + 5, "é two")]


@pytest.mark.parametrize("small", [1 << 16, 20])
def test_jaccard_classes(spark, monkeypatch, small):
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", small)
    monkeypatch.setattr(jaccard_join, "LEVELS", 3)
    rows = near_texts(120, 5)
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, node long")
    assert {tuple(r) for r in jaccard_join.classes(docs, 80, 3).collect()} == brute_classes(rows, 80, 3)


def words_by_hash():
    """Words of which a window begins with the first kind, and words that come after."""
    memo, low, high = jaccard_join.word_memo(), [], []
    for k in range(60_000):
        h = int(jaccard_join.shingle_sets([f"w{k}"], 1, memo)[0][0])
        (low if h < 1 << 62 else high).append(f"w{k}")
    return iter(low), iter(high)


def test_jaccard_link_across_regions(spark, monkeypatch):
    """x and y link inside a region of far pivots; x alone has near pivots in another region."""
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 100)
    monkeypatch.setattr(jaccard_join, "LEAST_HOT", 10**6)
    low, high = words_by_hash()
    take = lambda words, n: [next(words) for _ in range(n)]
    rows = []
    for _ in range(3):
        both, other, rest = take(low, 12), take(low, 5), take(high, 79)
        texts = [both + other + take(low, 4) + rest, both + take(low, 9) + rest]
        texts += [both + take(low, 9) + take(high, 79) for _ in range(40)]
        texts += [other + take(low, 16) + rest[:72] + take(high, 7) for _ in range(40)]
        rows += [(len(rows) + k, " ".join(t)) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in jaccard_join.classes(docs, 80, 1).collect()} == brute_classes(rows, 80, 1)


def test_jaccard_few_pairs_of_common_passages(spark, monkeypatch):
    """Shingles that are rare in every batch but common over all come late: texts that only share these hardly ever meet."""
    seen, measured = [], jaccard_join._measured
    monkeypatch.setattr(jaccard_join, "_measured", lambda pairs, known: [seen.append(pairs.distinct().count()), measured(pairs, known)][1])
    rnd = random.Random(3)
    common = [" ".join(f"c{k}x{j}" for j in range(3)) for k in range(300)]
    rows = [(i, " ".join(" ".join([f"own{i}x{k}", rnd.choice(common)]) for k in range(40))) for i in range(400)]
    rows += [(400 + i, f"{rows[i][1]} more") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        found = {r["doc_id"]: r["component_id"] for r in jaccard_join.classes(docs, 90, 3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {i: i - 400 if i >= 400 else i for i, _ in rows}
    assert sum(seen) < 400


@pytest.mark.parametrize("rounds", [1, 4])
def test_jaccard_crowds(spark, monkeypatch, rounds):
    """Groups around one text, of which some pairs link; large regions are dealt out, and rounds end with all that is left."""
    monkeypatch.setattr(jaccard_join, "CROWD", 3)
    monkeypatch.setattr(jaccard_join, "SMALL_REGION", 30)
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    rnd = random.Random(7)
    rows = []
    for g in range(3):
        base = [f"g{g}w{k}" for k in range(60)]
        for _ in range(40):
            w = list(base)
            for _ in range(rnd.randint(2, 12)):
                w[rnd.randrange(60)] = f"e{rnd.randrange(10**6)}"
            rows.append((len(rows), " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard_join.classes(docs, 80, 1).collect()} == brute_classes(rows, 80, 1)


def test_jaccard_edges(spark):
    docs = spark.createDataFrame([(7, "a b c d"), (7, "a b c d"), (None, "a b c d"), (9, "x y z w"), (9, "a b c d"), (3, "q")], "doc_id long, text string")
    found = sorted(map(tuple, jaccard_join.classes(docs, 90, 3).collect()), key=repr)
    assert found == sorted([(7, 2, 7), (7, 2, 7), (None, 2, 7), (9, 2, 9), (9, 2, 7), (3, 1, 3)], key=repr)
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs, 90, 3).collect()) == [3, 7, 9]
    assert jaccard_join.classes(docs.limit(0), 90, 3).count() == 0


def test_one_of_each_without_ids(spark):
    rows = [(7, "a b c d", 0), (None, "A b c d", 1), (None, "u v w x", 2), (None, "k l m n", 3), (None, "k l m n", 4), (None, None, 5), (None, " ", 6), (5, "q r s t", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int")
    found = jaccard_join.one_of_each(docs, 90, 3)
    assert found.columns == docs.columns
    places = sorted(r["place"] for r in found.collect())
    assert places in ([0, 2, 3, 5, 6, 7], [0, 2, 4, 5, 6, 7])


def test_one_of_each_judges_rows(spark):
    """One row of each group stays, whatever the ids of its texts do elsewhere; clashing columns come through."""
    rows = near_texts(80, 8)
    rows += [(rows[k][0], f"text of {k} alone and no other") for k in range(0, 30, 3)] + rows[:20] + [(None, rows[5][1]), (None, "nowhere else at all")]
    names = ["_node", "_maybe", "_word", "_gone", "_row", "_id", "node", "doc", "first"]
    docs = spark.createDataFrame([(i, t, *[k] * len(names)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    found = jaccard_join.one_of_each(docs.repartition(3), 80, 3)
    assert found.columns == docs.columns
    kept = [r["_node"] for r in found.collect()]
    sets = [shingles(t, 3) for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    group = least_reachable(range(len(rows)), pairs)
    assert len(kept) == len(set(kept)) and {group[k] for k in kept} == set(group.values()) and len(kept) == len(set(group.values()))
    last = max(i for i, _ in rows if i is not None) + 1
    order = lambda k: last if rows[k][0] is None else rows[k][0]
    assert all(order(k) == min(order(j) for j in group if group[j] == group[k]) for k in kept)
    assert jaccard_join.one_of_each(docs.limit(0), 80, 3).count() == 0


def test_components_chain(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (None, 3)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def brute_vectors(rows, cosine):
    width = max(len(v) for _, v in rows if v)
    x, ok = np.zeros((len(rows), width)), []
    for k, (_, v) in enumerate(rows):
        ok.append(bool(v) and None not in v and bool(np.isfinite(v).all()) and any(v))
        if ok[-1]:
            x[k, : len(v)] = v
    norm = np.linalg.norm(x, axis=1)
    x /= np.where(norm > 0, norm, 1)[:, None]
    near = (x @ x.T >= cosine) & np.outer(ok, ok)
    np.fill_diagonal(near, False)
    label = least_reachable([i for i, _ in rows], [(rows[a][0], rows[b][0]) for a, b in np.argwhere(near)])
    return {(i, int(n), label[i], i == label[i]) for (i, _), n in zip(rows, near.sum(axis=1), strict=True)}


def test_embedding_join(spark, monkeypatch):
    monkeypatch.setattr(embedding_join, "STRIPE", 48)
    monkeypatch.setattr(embedding_join, "BLOCK", 8)
    rng = np.random.default_rng(1)
    centres, rows = rng.normal(size=(8, 5)), []
    for i in range(400):
        v = (centres[i % 8] + rng.normal(size=5) * rng.choice([0, 0.1, 0.4])).tolist()
        v = {0: None, 1: [0.0] * 5, 2: [1.0, None], 3: [float("nan")] * 5, 4: [], 5: v[:3]}.get(i % 40, v)
        rows.append((i, v, 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, place int")
    found = {tuple(r) for r in embedding_join.near_duplicates(df, 0.9).select("vec_id", "n_links", "component_id", "kept").collect()}
    assert found == brute_vectors([(i, v) for i, v, _ in rows], 0.9)
    assert embedding_join.near_duplicates(df.limit(0)).count() == 0


def test_archives(spark, monkeypatch):
    long = "é" * 60
    rows = [(1, "http://a/\n", long, 0), (2, None, long, 0), (3, "u", None, 0), (4, "u", "", 0), (5, "u", "short", 0), (6, "u", "short", 0), (None, "u", long, 0), (2, None, long, 0), (8, "u", "z" * 300_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    folder = scratch_path(spark, "warc-test")
    manifest = archives.write(archives.with_roles(pages), folder, package_bytes=400)
    found = archives.read(manifest).collect()
    assert len(found) == len(rows)
    urls = {i: u for i, u, *_ in rows}
    for r in found:
        html = next(h for i, _, h, _ in rows if i == r["page_id"]) or ""
        revisit = html == long and r["page_id"] != 1
        assert (r["record_type"], r["refers_to"]) == (("revisit", 1) if revisit else ("response", None))
        assert r["payload_bytes"] == len(html.encode()) and r["url"] == urls[r["page_id"]]
        assert r["payload"] is None if revisit else bytes(r["payload"]).decode() == html
    for r in manifest.collect():
        path = r["path"].removeprefix("file:")
        assert zipfile.ZipFile(path).testzip() is None
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    assert archives.round_trip(pages.limit(0)).count() == 0


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 10)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    path = tmp_path / "x.zip"
    with zipfile.ZipFile(path, "w") as z:
        for k in range(5):
            z.writestr(f"m{k}", f"{k}" * 40)
    assert b"PK\x06\x06" in path.read_bytes()
    with open(path, "rb") as f:
        directory = archives.ZipDirectory(f, path.stat().st_size)
        assert [directory.range(*directory.stored(f"m{k}")) for k in range(5)] == [f"{k}".encode() * 40 for k in range(5)]


def test_url_filters(spark):
    rnd = random.Random(3)
    labels = ["com", "net", "example", "www", "a", "b"]
    host = lambda: ".".join(rnd.choice(labels) for _ in range(rnd.randint(1, 4)))
    rules = sorted({(host(), rnd.choice(["/", "/en/", "/en/x", ""]), rnd.choice(["allow", "block"])) for _ in range(60)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    urls = [f"http://{host().upper() if k % 9 == 0 else host()}{rnd.choice(['', '/', '/en/', '/en/xy?q=/', '#/en/', '?a', '/EN/'])}" for k in range(200)]
    urls += [None, "", "no scheme", "x://", "://a", "http://a.com/en/://b"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    found = {r["page_id"]: r for r in url_filters.judge(pages, url_filters.rules_table(spark, rules)).collect()}
    assert len(found) == len(urls)
    for i, u in enumerate(urls):
        rest = (u or "").partition("://")[2] if "://" in (u or "") else ""
        cut = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
        h, tail = rest[:cut].lower(), rest[cut:]
        p = tail[: next((k for k, c in enumerate(tail) if c in "?#"), len(tail))]
        fit = [r for r in rules if (h == r[0] or h.endswith("." + r[0])) and p.startswith(r[1])]
        best = max((len(r[0] + r[1]) for r in fit), default=None)
        r = found[i]
        assert (r["host"], r["path"]) == (h, p)
        assert (r["rule"] is None) == (not fit) and (not fit or len(r["rule"]) == best and r["rule"] in {x[0] + x[1] for x in fit})
        assert fit or r["verdict"] == url_filters.DEFAULT_VERDICT
    assert url_filters.judge(pages.limit(0), url_filters.rules_table(spark, rules)).count() == 0


def test_pipeline_stage_by_stage(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scores = {r["doc_id"]: r["score"] for r in quality.scored(docs, labels).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect() if scores[r["doc_id"]] >= quality.THRESHOLD]
    kept = {i for i, _, c in brute_classes(rows, 80, 5) if i == c}
    items = [decontamination.normal(r["text"]) for r in bench.collect()]
    clean = {i for i, t in rows if i in kept and not any(x in decontamination.normal(t or "") for x in items)}
    found = corpus_pipeline.run(spark, sf).collect()
    # Passages with edits go too.
    assert {r["doc_id"] for r in found} <= clean and len(found) >= 0.97 * len(clean)
    texts = dict(rows)
    assert all(r["ids"] == bpe.vocabulary(bpe.default_path()).ids(texts[r["doc_id"]] or "").tolist() for r in found)
