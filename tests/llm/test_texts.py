"""Tokens, main text, decontamination and quality against the library or brute force."""

import hashlib
import random
import struct
import zlib
from pathlib import Path
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from placequery.functions.storage import scratch_path
from placequery.llm import bpe, common, decontamination, main_text, prefix_counts, quality, token_files, words

LETTERS = "abcthein' \t\n\x0b\x1c\x85\u3000\u200béßÇüΣσςİ日本srevl!?.,-_0129½²🙂"
ODD = ["", None, " \n", "a", "x" * 3000, "don't'll 're", "<|endoftext|>", "abc<|startoftext|> <|endof", "ΑΣ İ e\u0301"]


def texts(n, seed):
    rnd = random.Random(seed)
    special = ["<|endoftext|>", "<|startoftext|>", "<|endof"]
    made = ["".join(rnd.choice(LETTERS) if rnd.random() < 0.98 else rnd.choice(special) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return ODD + made


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i) for i, t in enumerate(texts(300, 1))]
    # A repeated row, a null id and extra columns with names the operators use.
    return spark.createDataFrame([*rows, rows[0], (None, "with no id", 1)], "doc_id long, text string, ids long").cache()


def test_bpe_matches_library(docs, library):
    for r in bpe.decode(bpe.encode(docs)).collect():
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == library.decode(want, skip_special_tokens=False)


def test_digests_match_library(docs, library):
    def want(doc_id, text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed, decoded = struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)
        return doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    found = [tuple(r) for r in bpe.digests(docs).collect()]
    assert sorted(found, key=repr) == sorted((want(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)


def test_one_pass_equals_two(docs):
    columns = ["doc_id", "text", "ids", "decoded"]
    two = bpe.decode(bpe.encode(docs)).select(*columns).collect()
    assert sorted(bpe.encode_and_decode(docs).select(*columns).collect(), key=repr) == sorted(two, key=repr)


def test_worker_keeps_the_operators_of_its_stage(monkeypatch):
    stage = SimpleNamespace(now=1)
    monkeypatch.setattr(common, "_held", {})
    monkeypatch.setattr(common.TaskContext, "get", classmethod(lambda cls: SimpleNamespace(stageId=lambda: stage.now)))
    for owner in "ab":
        assert common.held(owner, 0, lambda: owner) == owner
    stage.now = 2
    common.held("b", 0, lambda: "anew")
    assert list(common._held) == [("b", 0)] and common.held("b", 0, lambda: "anew") == "b"
    common.drop_held("b")
    assert not common._held


def test_long_word_and_wide_trees(library):
    vocabulary = bpe.vocabulary(bpe.default_path())
    for word in ("abcd" * 20_000, "é" * 40, "thethethe" * 5):
        assert vocabulary.ids(word).tolist() == library.encode(word, add_special_tokens=False).ids
    many = [w for t in texts(800, 2) if t for w in words.PIECE.findall(words.normal(t))]
    assert vocabulary.piece_codes(many) == [bpe.np.array(vocabulary.piece(w), "<u4").tobytes() for w in many]


def test_a_token_of_its_own_is_judged_once(monkeypatch):
    counter, judged = prefix_counts.PrefixCounts(bpe.default_path()), []
    fits = counter.fits
    monkeypatch.setattr(counter, "fits", lambda left, right: judged.append((left, right)) or fits(left, right))
    counter.text_steps("banana bandana cabana nirvana savanna \u010cesk\u00e1 na\u00efve 12na ana's")
    alone = [right for left, right in judged if left < 0]
    assert alone and len(alone) == len(set(alone))


def test_prefix_counts_at_every_prefix(library):
    counter = prefix_counts.PrefixCounts(bpe.default_path())
    for text in texts(250, 3):
        normal = "".join(p if special else words.normal(p) for p, special in words.segments(text or ""))
        if len(normal) > 200:
            continue
        counts = counter.text_steps(text or "").cumsum().tolist()
        assert counts == [len(library.encode(normal[: i + 1], add_special_tokens=False).ids) for i in range(len(normal))]


def test_prefix_table_answers(docs, library):
    made = prefix_counts.prefix_table(docs)
    rows = made.withColumns({
        "at": prefix_counts.tokens_at(F.col("prefix_table"), F.lit(5)), "cut": prefix_counts.longest_prefix(F.col("prefix_table"), F.lit(3)),
    }).collect()
    for r in rows:
        assert r["n_tokens"] == len(library.encode(r["text"] or "", add_special_tokens=False).ids)
        steps = prefix_counts.unpacked(bytes(r["prefix_table"])).cumsum()
        assert r["at"] == (steps[:5][-1] if len(steps) else 0)
        assert r["cut"] == max((i + 1 for i, c in enumerate(steps) if c <= 3), default=0)


def test_prefix_counts_of_many_texts(library):
    counter = prefix_counts.PrefixCounts(bpe.default_path())
    asked = [t or "" for t in texts(200, 5)] + ["A word, a word. A w\u00f6rd", "x <|ENDOFTEXT|> y"]
    found = list(counter.all_steps(asked))
    assert [f.tolist() for f in found] == [counter.text_steps(t).tolist() for t in asked]
    assert [int(f.sum()) for f in found] == [len(library.encode(t, add_special_tokens=False).ids) for t in asked]


def test_codes_ask_once_for_a_run(library):
    asked = []
    coder = words.TextCoder(lambda pieces: [p.encode() for p in pieces], lambda special: asked.append(special) or b"!", entries=3)
    # The special string in capitals is ordinary text; long runs are in no memo.
    for _ in range(3):
        assert list(coder.codes(["Ab, ab. <|endoftext|>ab", None, "", "<|ENDOFTEXT|> " + "x" * 99])) == [b"ab,ab.!ab", b"", b"", b"<|endoftext|>" + b"x" * 99]
    memo = common.Memo(str.upper, 2, turns=False)
    assert memo.fresh(["a", "b"]) == ["a", "b"]
    memo.take({"a": "A", "b": "B"})
    memo.turn()
    assert memo.fresh(["a", "c"]) == ["c"] and dict(memo) == {"a": "A"} and memo["b"] == "B"


def test_chunks_are_cut_together_and_coded_once(library):
    asked = []
    coder = words.TextCoder(lambda pieces: asked.append(pieces) or [f"[{p}]".encode() for p in pieces], str.encode)
    found = list(coder.codes(["it's " + "y" * 99 + " ab, don't", "ab, <|endoftext|>" + "y" * 99, " ", "日本²½"]))
    long = "[" + "y" * 99 + "]"
    assert found == [f"[it]['s]{long}[ab][,][don]['t]".encode(), f"[ab][,]<|endoftext|>{long}".encode(), b"", "[日本][²][½]".encode()]
    # One call for the whole group, also for pieces too long for the memo.
    assert len(asked) == 1 and len(asked[0]) == len(set(asked[0]))
    assert list(coder.codes(["ab, it"])) == [b"[ab][,][it]"] and len(asked) == 1
    made = [p for t in texts(300, 3) if t for p in words.PIECE.findall(words.normal(t))]
    assert words.all_letters(made) == [words.as_letters(p) for p in made] and words.all_letters([]) == []


def test_coded_texts_are_handed_on_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(words, "GROUP_CHARS", 10)
    batch = bpe.pa.array(["12345678", None, "", "9012", "x" * 50, "é", "y"])
    assert [p.to_pylist() for p in bpe.parts([batch, batch[:0], batch[4:]])] == [
        ["12345678", None, "", "9012"], ["x" * 50], ["é", "y"], [], ["x" * 50], ["é", "y"]]
    monkeypatch.undo()
    # A batch of several parts gives every row its own result.
    rows = [(i, f"{i} word " * 150_000) for i in range(8)]
    wide = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    ends = {r["doc_id"]: (r["n"], r["first"]) for r in bpe.encode_and_decode(wide).selectExpr("doc_id", "size(ids) n", "substr(decoded, 1, 1) first").collect()}
    assert ends == {i: (300_000, str(i)) for i in range(8)}
    assert {r["doc_id"]: r["n_tokens"] for r in bpe.digests(wide).collect()} == {i: 300_000 for i in range(8)}


def test_plain_token_files_are_compressed(spark):
    folder = scratch_path(spark, "plain")
    rows = [(i, " ".join(f"the {k % 7} word" for k in range(4000))) for i in range(4)]
    manifest = token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), folder).collect()
    on_disk = sum(f.stat().st_size for f in Path(folder.removeprefix("file:"), "plain").iterdir())
    assert on_disk < sum(r["n_tokens"] for r in manifest)


def test_token_files_round_trip(spark, docs, library):
    folder = scratch_path(spark, "tokens-test")
    rows = token_files.read(token_files.write(docs, folder), folder).orderBy("start").collect()
    want = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r["doc_id"] for r in rows] == [d for d, _ in want]
    at = 0
    for r in rows:
        assert r["start"] == at
        at += len(r["ids"])
    by_id = {d: library.encode(t or "", add_special_tokens=False).ids + [token_files.END_ID] for d, t in want}
    assert all(r["ids"] == by_id[r["doc_id"]] for r in rows)
    assert all(r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(r['ids'])}I", *r["ids"])) for r in rows)
    assert token_files.round_trip(docs.limit(0)).count() == 0


def test_codec_lengths():
    ranks = bpe.np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1] * 3, bpe.np.uint32)
    assert token_files.unpack(*token_files.pack(ranks), len(ranks)).tolist() == ranks.tolist()


PAGE = (
    "<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><div class='ad'>buy this now please</div>"
    "<main><h1>Title &amp; more</h1><p>First   paragraph\nof the <b>text</b>.<p>Second &#233; one.<ul><li>a<li>b</ul></main>"
    "<div id=comments><p>a reader says something long here</div><form>mail <input></form><script>var t='</p>'</script><footer>&copy;</footer>"
)


def test_main_text(spark):
    want = "Title & more\nFirst paragraph of the text.\nSecond é one.\na\nb"
    cases = {PAGE: want, None: "", "": "", "plain words": "plain words", "<p>": "", "<" * 5000: "<" * 5000, "<div>" * 3000 + "x": "x", "<!--": ""}
    df = spark.createDataFrame([(i, h, "clash") for i, h in enumerate(cases)], "page_id long, html string, text string")
    found = {r["page_id"]: r["text"] for r in main_text.extract(df).collect()}
    assert [found[i] for i in range(len(cases))] == list(cases.values())
    assert main_text.extract(df.limit(0)).count() == 0


LONG = "A sentence of the article that goes on for a while, with commas, and then ends. " * 4


@pytest.mark.parametrize("attributes", ['class="entry-header"', 'class="article-header"', 'id="related-work"', 'class="legal"', 'id="side"'])
def test_main_text_keeps_named_parts_of_the_article(attributes):
    page = f"<body><article><div {attributes}><h1>Title</h1><p>{LONG}</p></div><p>{LONG}</p></article></body>"
    assert main_text.main_text(page).split("\n") == ["Title", LONG.strip(), LONG.strip()]


def test_main_text_still_drops_marked_parts():
    page = f"<body><article><p>{LONG}</p><div class='post-share'>Share it</div><ul class='related-posts'><li>More</ul></article><div class='site-header'>Site</div></body>"
    assert main_text.main_text(page) == LONG.strip()


def test_main_text_hidden_is_an_attribute():
    for attributes in ('title="the hidden cost"', 'data-x="a hidden b"', 'title="display: none"', 'data-id="menu"'):
        assert main_text.main_text(f"<body><div><p {attributes}>{LONG}</p></div></body>") == LONG.strip()
    for attributes in ("hidden", 'hidden=""', "style='color:red; display: none'", 'aria-hidden="true"'):
        assert main_text.main_text(f"<body><div><p>{LONG}</p><p {attributes}>gone</p></div></body>") == LONG.strip()


def test_main_text_form_around_the_page():
    assert main_text.main_text(f"<body><form action='/'><input name='state'><div><p>{LONG}</p><p>{LONG}</p></div></form></body>").count("\n") == 1
    assert main_text.main_text(f"<body><div><p>{LONG}</p><form><p>Your name</p></form></div></body>") == LONG.strip()


def test_main_text_outside_the_body_tags():
    assert main_text.main_text(f"<html><body><p>{LONG}</p></body><p>{LONG}</p></html><p>{LONG}</p>").split("\n") == [LONG.strip()] * 3
    assert main_text.main_text(f"<html><head><title>x</title></head><p>{LONG}</p><body><p>{LONG}</p></body></html>").split("\n") == [LONG.strip()] * 2


def semi_global(passage, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(passage, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_decontamination_against_alignment(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(4, 30)))) for i in range(12)] + [(90, "tiny"), (91, None), (92, "")]
    rows = []
    for k in range(40):
        passage = list(items[k % 12][1])
        for _ in range(int(rnd.choice([0, 0.04, 0.08, 0.15]) * len(passage))):
            passage[rnd.randrange(len(passage))] = rnd.choice(["", "z", "qq"])
        rows.append((k, " ".join(word() for _ in range(20)) + " " + "".join(passage).upper() + ", " + " ".join(word() for _ in range(9)), "x"))
    rows += [(100, None, "x"), (101, "", "x"), (102, "so tiny a text", "x"), (103, "tinyx", "x"), rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, matches string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for chars in (1 << 20, 300):  # one block of items, and several
        found = decontamination.find(docs, bench, block_chars=chars).collect()
        assert len(found) == len(rows)
        for r in found:
            text, want = decontamination.normal(r["text"] or ""), {}
            for i, t in items:
                p = decontamination.normal(t or "")
                if len(p) >= decontamination.Q:
                    budget = min(int(decontamination.EDIT_RATE * len(p)), (len(p) - decontamination.Q) // decontamination.Q)
                    if (edits := semi_global(p, text)) <= budget:
                        want[i] = edits
                elif p and f" {p} " in f" {text} ":
                    want[i] = 0
            assert {m["item_id"]: m["edits"] for m in r["matches"]} == want
    assert {r["doc_id"] for r in decontamination.clean(docs, bench).collect()} == {r["doc_id"] for r in found if not r["matches"]}
    assert decontamination.clean(docs, bench.limit(0)).count() == len(rows)


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows) and len(rows) > 50


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (None, "a b", 5), (2, "word " * 50, 5)], "doc_id long, text string, score long")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()] == [0.5] * 4
    assert quality.scored(docs.limit(0), labels).count() == 0
