"""The text operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import collections
import hashlib
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from screenwell.llm import bytebpe, catalog, chat, exact, html, jaccard, langid, nbsvm, packing, rules, spans
from screenwell.llm.tokenizers import tokenizer_path
from tests.oracle import compare, connect

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, key long, n long, id string"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards quietly box five dozen liquor jugs near old rivers"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", i, 0, "x") for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd():
    words = PROSE.split()
    long = " ".join(f"w{k % 7919}" for k in range(60_000))
    near = [" ".join(words[:k] + ["other"] + words[k + 1:]) + " " + " ".join(f"tail{j}" for j in range(40)) for k in range(0, 20, 3)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", PROSE, PROSE, PROSE + " end", PROSE.upper(), long, long + " more", "a b c d e f g", "a b c d e f g h", *near]
    return [*enumerate(texts), (3, "one"), (None, PROSE)]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def linked(rows, percent=80):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    root = {i: i for i in ids}

    def find(x):
        return x if root[x] == x else find(root[x])
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_jaccard_components(spark, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, odd)).collect() if r["doc_id"] is not None}
    assert got == linked(odd)
    assert jaccard.jaccard_components(table(spark, [])).count() == 0
    left = {r["doc_id"] for r in jaccard.one_per_component(table(spark, odd)).collect()}
    assert left == {i for i, (_, c) in linked(odd).items() if i == c} | {None}


def test_small_sets_by_subsets(spark):
    words = [f"x{k}" for k in range(12)]
    rows = list(enumerate([" ".join(words[:n]) for n in range(1, 13)] + [" ".join([*words[:n], "y"]) for n in range(4, 12)]))
    assert jaccard.boundary({n: 100 for n in range(1, 20)}, 80) > 5
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(table(spark, rows)).collect()}
    assert got == linked(rows)


@pytest.mark.parametrize("keys", [None, 3, 1])
def test_exact_groups(spark, odd, monkeypatch, keys):
    """Also where different texts share a key: chains tell them apart by their bytes, not by a digest."""
    if keys:
        monkeypatch.setattr(exact, "key_of", lambda norm: F.pmod(F.xxhash64(norm), F.lit(keys)).cast("long"))
    norm = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in odd}
    rows = [(i, t or "", re.sub(r"[\x20\x09-\x0D]", "", t or "")) for i, t in odd]
    for capacity in (1_000_000, 2):
        for r in exact.exact_groups(table(spark, odd), capacity=capacity).collect():
            if r["doc_id"] is None:
                continue
            same = [x for x in rows if x[2] == norm[r["doc_id"]]]
            keep = min((x for x in same if x[0] is not None), key=lambda x: (-len(x[1]), x[0]))[0]
            assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(same), keep == r["doc_id"])
            assert r["text_sha256"] == hashlib.sha256(norm[r["doc_id"]].encode()).hexdigest()
    assert exact.exact_groups(table(spark, [])).count() == 0


def test_exact_index(spark):
    """Buckets are as small as asked for, however deep the directory must be, and an owner's keys are a range; chains number the texts of a key."""
    docs = table(spark, [(i, f"text {i // 2}") for i in range(2000)] + [(5000, "text 0")])
    rows = exact.narrow(docs, "doc_id", "text")
    index = exact.build_index(docs, rows, "doc_id", "text", capacity=3).collect()
    buckets = collections.defaultdict(list)
    for r in index:
        buckets[tuple(r["bucket"])].append(r)
    assert len(index) == 1000 and max(map(len, buckets.values())) <= 3 and max(b[0] for b in buckets) > 8
    spans = sorted((min(r["key"] % (1 << 64) for r in b), max(r["key"] % (1 << 64) for r in b)) for b in buckets.values())
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert {(r["chain"], r["texts"], r["norm"]) for r in index} == {(1, 1, None)}
    assert {r["keep_id"]: r["group_size"] for r in index}[0] == 3 and sum(r["group_size"] for r in index) == 2001


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    threes = [tuple(w[k:k + 3]) for k in range(len(w) - 2)]
    often = collections.Counter(threes)
    inside = {k + j for k, t in enumerate(threes) if often[t] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(inside)


def test_quality_rules(spark, odd):
    texts = [*odd, (90, "é a b c\n\na b c\né a b c ##|"), (91, "x x x x")]
    got = {r["doc_id"]: r for r in rules.judge(table(spark, texts), []).collect()}
    for i, t in texts:
        assert tuple(got[i])[1:6] == brute_counts(t)
        n, *_, repeated = brute_counts(t)
        assert got[i]["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and got[i]["kept"] != got[i]["base_failed"]
    good = [(k, " ".join(f"word{(k * 31 + j * 7) % 997}" for j in range(80))) for k in range(60)]
    bad = [(100 + k, " ".join(f"w{(k * 17 + j * 5) % 997}%$#" for j in range(80))) for k in range(30)]
    docs = table(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad], "doc_id long, quality int")
    found = rules.learn_rules(docs, labels)
    assert found and {r["doc_id"] for r in rules.judge(docs, found).filter("kept").collect()} == {i for i, _ in good}
    assert {r["doc_id"] for r in rules.keep_good(docs, found).collect()} == {i for i, _ in good}
    assert rules.learn_rules(docs, labels.limit(0)) == []


def test_spans(spark):
    passage = " ".join(f"Sentence {k} has a few words in it that repeat." for k in range(6))
    rows = [(1, f"Alpha begins here. {passage} Then it ends."), (2, f"beta runs on {passage} and on."), (3, "Nothing in common."),
            (4, None), (5, ""), (None, passage)]
    got = {r["doc_id"]: r for r in spans.remove_repeats(table(spark, rows)).collect()}
    assert got[1]["text"] == rows[0][1] and got[3]["text"] == rows[2][1] and got[None]["text"] == passage
    assert got[2]["text"].split() == "beta runs on and on.".split() and got[2]["n_removed"] == 6
    assert got[4]["text"] is None and got[5]["text"] == ""
    assert b"".join(spans.sentences(passage.encode())) == passage.encode()
    kept = {r["doc_id"] for r in spans.cut_repeats(table(spark, [*rows, (9, passage)])).collect()}
    assert kept == {1, 2, 3, 4, 5, None}
    own = [(1, f"Alpha. {passage} Middle part. {passage} End."), (2, passage), (2, passage), (3, passage), (3, None)]
    got = sorted((r["doc_id"], r["text"] or "") for r in spans.remove_repeats(table(spark, own)).collect())
    assert [(i, t.split()) for i, t in got] == [(1, f"Alpha. {passage} Middle part. End.".split()), (2, []), (2, []), (3, []), (3, [])]
    assert sorted((r["doc_id"], r["n"]) for r in spans.cut_repeats(table(spark, own)).collect()) == [(1, 0), (3, 0)]
    assert spans.remove_repeats(table(spark, [])).count() == 0


def test_packing(spark, odd):
    from tokenizers import Tokenizer
    path = tokenizer_path("word_bpe_49k.json")
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    extra = [(200, "Á ΟΣ it's\x1cx <|endoftext|> ̈́ẛ̣ 12ab, \x05!"), (201, "՘a 中文")]
    rows = [*[r for r in odd if r[0] is not None and r[0] != 3], *extra]
    ids = {i: [*made.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}
    places, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(table(spark, rows), path, windows=4).collect():
        part = b"".join(k.to_bytes(4, "little") for k in ids[r["doc_id"]][r["start"]:r["start"] + r["length"]])
        assert (bytes(r["ids"]), r["ids_crc32"], r["doc_tokens"]) == (part, zlib.crc32(part), len(ids[r["doc_id"]]))
        places[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for group in (*places.values(), *sequences.values()):
        at = 0
        for start, length in sorted(group):
            assert start == at
            at += length
    assert {i: sum(n for _, n in p) for i, p in places.items()} == {i: len(x) for i, x in ids.items()}
    lengths = [sum(n for _, n in s) for s in sequences.values()]
    assert max(lengths) <= 4096 and sum(4096 - n for n in lengths if n & (n - 1)) <= 16 * len(lengths)


def test_byte_bpe(spark, odd):
    import tiktoken
    from public_tokenizers import PATTERN
    path = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*[r for r in odd if r[0] is not None and r[0] != 3], (300, "\x00 \U0001f600 กำ  \n\n it's 12 <|endoftext|>")]
    coded = bytebpe.encode(table(spark, rows), path, PATTERN)
    assert {r["doc_id"]: r["ids"] for r in coded.collect()} == {i: want.encode_ordinary(t or "") for i, t in rows}
    assert {r["doc_id"]: bytes(r["data"]) for r in bytebpe.decode(coded, path).collect()} == {i: (t or "").encode() for i, t in rows}


def test_language_and_quality_learn(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = catalog.QUERIES["op1_language_id"](spark, SMOKE).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang_pred <> 'und'")
    assert out.filter("lang = lang_pred").count() >= 0.9 * out.count()
    model = langid.learn_dictionaries(docs)
    odd = {r["doc_id"]: r for r in langid.predict(table(spark, [(1, None), (2, ""), (3, "12 !!"), (4, "the")]), model).collect()}
    assert [odd[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and odd[4]["lang_pred"] in model
    assert langid.predict(table(spark, [(1, "text")]), {}).first()["lang_pred"] == "und"
    scores = catalog.QUERIES["op6_quality_classifier"](spark, SMOKE).join(spark.read.parquet(f"{SMOKE}/labels.parquet"), "doc_id").filter("held_out")
    assert scores.filter("predicted = quality").count() >= 0.8 * scores.count()
    blank = nbsvm.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert [r["score"] for r in nbsvm.score(table(spark, [(1, None), (2, "x")]), blank).collect()] == [0.5, 0.5]


def test_chat_layouts(spark):
    turns = [("user", "hi <|end|> \\<| \\"), (chat.ASSISTANT, "<|turn|>ok")]
    records = [{"messages": [{"role": r, "content": t} for r, t in turns]}, {"conversations": [{"from": {"user": "human", chat.ASSISTANT: "gpt"}[r], "value": t} for r, t in turns]},
               {"prompt": turns[0][1], "completion": turns[1][1]}, {"instruction": turns[0][1], "input": "", "output": turns[1][1]}, {"other": 1}]
    rows = spark.createDataFrame([(k, json.dumps(r)) for k, r in enumerate(records)] + [(9, None)], "k long, j string")
    got = chat.canonical_turns(rows.select("k", F.parse_json("j").alias("record"))).select("k", "layout", F.posexplode_outer("turns").alias("p", "s"))
    got = got.select("k", "layout", "p", "s.role", "s.text").cache()
    assert {r["k"] for r in got.filter("layout is null").collect()} == {4, 9}
    out = chat.format_turns(got.filter("layout is not null"), "k", ["p"]).withColumn("back", chat.read_back(F.col("formatted")))
    for r in out.collect():
        assert [tuple(x) for x in r["back"]] == turns
        assert [chat_undo(r["formatted"][m["begin"]:m["begin"] + m["length"]]) for m in r["loss_mask"]] == [turns[1][1]]


def test_chat_odd_rows(spark):
    """Null roles, texts and keys, equal turns, repeated rows, clashing columns and an empty table."""
    shape = "key long, turn long, role string, text string, layout string, turns int, parts string, begin long, head string, back string"
    rows = [(1, 0, None, None), (1, 0, None, None), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, 0, "assistant", ""),
            (3, 0, "user", "same"), (3, 0, "user", "same")]
    df = spark.createDataFrame([(*r, "l", 1, "p", 2, "h", "b") for r in rows], shape)
    out = chat.format_turns(df, "key", ["turn"])
    assert out.columns == ["key", "formatted", "loss_mask"]
    back = {r["key"]: [tuple(x) for x in r["back"]] for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert back == {1: [("", ""), ("", ""), ("assistant", ""), ("assistant", "a"), ("assistant", "b")], None: [("user", "x")], 2: [("assistant", "")], 3: [("user", "same")] * 2}
    masks = {r["key"]: [r["formatted"][m["begin"]:m["begin"] + m["length"]] for m in r["loss_mask"]] for r in out.collect()}
    assert masks == {1: ["", "a", "b"], None: [], 2: [""], 3: []}
    assert chat.format_turns(df.limit(0), "key", ["turn"]).collect() == []
    records = df.withColumn("record", F.to_variant_object(F.struct("turn", F.col("text").alias("prompt"))))
    got = chat.canonical_turns(records)
    assert got.columns == [*df.columns[:4], "layout", "turns", *df.columns[6:], "record"] and got.count() == len(rows)
    assert {r["layout"] for r in got.collect()} == {"prompt_turn"} and chat.canonical_turns(records.limit(0)).collect() == []


def chat_undo(text):
    return re.sub(r"\\([\\|])", r"\1", text)


def test_html(spark):
    page = ("<html><head><title>t</title></head><body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>A &amp; B</h1><p>One<b>two</b>"
            "<br>three&nbsp;four<script>var a='</p>'</script></p><section class=comments><p>nice</p></section><aside>buy</aside></article><footer>f</footer></body></html>")
    shared = "<p>shared words that every page of this host says again and again</p>"
    plain = [f"<body><div><p>unique text number {k} of its own kind{k} with{k} words{k}</p></div>{shared}</body>" for k in range(3)]
    rows = [(1, "http://h.org/1", page), (2, None, None), (3, "x", ""), (4, "http://h.org/1", page), *[(10 + k, "http://p.org/", p) for k, p in enumerate(plain)]]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    for size in (1 << 23, 100):
        got = {r["page_id"]: r["text"] for r in html.extract(pages, shard_bytes=size).collect()}
        assert got[1] == got[4] == "A & B Onetwo three four" and got[2] == got[3] == ""
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    assert [got[10 + k] for k in range(3)] == [f"unique text number {k} of its own kind{k} with{k} words{k}" for k in range(3)]


PARA = "<p>" + " ".join(f"word{k}" for k in range(30)) + "</p>"
MAIN = " ".join(f"word{k}" for k in range(30))
SHAPES = {
    "comment articles": f"<article>{PARA}</article><section class=comments><article class=comment><p>first!</p></article><article><p>me too</p></article></section>",
    "comments larger than the article": f"<article>{PARA}</article><section class=comments>" + "<article class=comment><p>so many words of a reader</p></article>" * 20 + "</section>",
    "comments inside the article": f"<article>{PARA}<div id=comments><article id=comment-1><p>nice</p></article></div></article>",
    "teasers": f"<main>{PARA}<aside><article><h2>Read on</h2><p>teaser text</p></article></aside></main>",
    "teasers in a menu": f"<nav><ul><li><article>Teaser</article></ul></nav><article>{PARA}</article>",
    "body class": f"<body class='has-sidebar no-menu'>{PARA}</body>",
    "body named": f"<body class='sidebar'>{PARA}</body>",
    "wrapper": f"<div class='content with-sidebar'>{PARA}<div class=sidebar><p>about me</p></div></div>",
    "named wrapper": f"<div class='page sidebar widget'>{PARA}<p>and <a href=x>some</a></p></div><div class=sidebar><p>about me</p></div>",
    "wrapper around main": f"<div class='header-page'><main class=search-page>{PARA}</main></div>",
    "page in a form": f"<body><form id=all>{PARA}<input></form></body>",
    "links outweigh the text": f"<div class=menu>{'<p><a href=x>one of the many links</a></p>' * 30}</div>{PARA}",
    "long advert": f"<div class=ad>{'buy this ' * 40}</div>{PARA}",
    "menu never closed": f"<nav><a href=x>home</a><article>{PARA}</article>",
    "stray end tag": f"<div><article>{PARA[:-4]}</div></article></div>",
    "item with blocks": f"<ul><li class=share><div>to a friend</div></ul><ul><li class=ad>buy<li>{PARA}</ul>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_html_landmarks(shape):
    found = html.blocks(SHAPES[shape])
    best = max((kind for kind, _ in found if kind != html.BOILERPLATE), key=lambda kind: kind == html.ARTICLE)
    got = " ".join(text for kind, text in found if kind == best)
    assert got == MAIN + " and some" * (shape == "named wrapper")


LOST = {
    "custom elements": f"<article><p>{PARA}<video-js></video-js><style-guide></style-guide></p> and some</article>",
    "quote in a bare value": f"<article><a title=it's>{PARA.split()[0]}</a> {PARA.split(None, 1)[1]} <em>and some</em></article>",
    "stray quote": f'<article><p title="5" tall">{PARA} and some</p></article>',
    "slugs": "<article>" + "".join(f'<section id="comments-on-the-law"><h2 id="{i}">{w}</h2></section>' for i, w in zip(
        ("related-work", "search-algorithms", "share-prices") * 99, (PARA + " and some").split())) + "</article>",
    "comments": f"<article><!--><p>{PARA}<!-- <p>no --> and<!-- no --!> some<!-- no </article>",
    "signs": f"<article>{PARA} and some<script>if (a<b) '<p>no</p>'</scripted></SCRIPT ><1></article>",
    "unclosed media": f"<article><p>{PARA}<video controls><p>and some<audio></article>",
    "cut short": f"<article><p>{PARA} and some <a href='x",
}


@pytest.mark.parametrize("shape", LOST)
def test_html_loses_no_text(shape):
    found = html.blocks(LOST[shape])
    assert " ".join(" ".join(t for k, t in found if k == html.ARTICLE).split()) in (MAIN + " and some", MAIN + " and some <1>")


@pytest.mark.parametrize("piece", ['<a "', "<script ", "<script>", "<video>", "<!--", "<!-- -->", "<p title='", "<svg>", "<", "</", "<div class=x>", "a=\"'", "&amp", "<!-->x"])
def test_html_is_linear(piece):
    """A megabyte of anything takes about as long as it is."""
    import time
    start = time.perf_counter()
    html.blocks(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - start < 10


@pytest.mark.parametrize("piece", [b" ", b"!", b".", b" \n", b"\n", b". ", b"A ", b"\xc3\x89 "])
def test_sentences_are_linear(piece):
    import time
    start = time.perf_counter()
    text = b"x" + piece * (1_000_000 // len(piece))
    assert b"".join(spans.sentences(text)) == text and time.perf_counter() - start < 10


def test_dictionaries_hold_slices_from_anywhere(spark):
    """A long shared header teaches no more than its share of a text; short texts are taken whole."""
    rows = [(i, "header " * 400 + "body " * 4000, "en", i, 0, "x") for i in range(40)] + [(100 + i, "kurzer Text", "de", i, 0, "x") for i in range(3)]
    learnt = langid.learn_dictionaries(spark.createDataFrame(rows, SCHEMA))
    assert learnt["de"].split(b"\n") == [b"kurzer text"] * 3
    assert learnt["en"].count(b"body") > 3 * learnt["en"].count(b"header") > 0


def test_spans_keep_clashing_columns(spark):
    """Columns named like the operator's own stay; ties of equal documents go to the smallest id; a very long text is cut whole."""
    line = " ".join(f"shared{k}" for k in range(30)) + "."
    long = " ".join(f"w{k}{'.' if k % 9 == 0 else ''}" for k in range(200_000))
    rows = [(1, f"Own one. {line} Own two.", 7, 8, 9), (2, f"Own three. {line} Own four.", 7, 8, 9), (3, f"{long}. {line}", 7, 8, 9), (4, None, 7, 8, 9), (5, "", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long, places long, id long")
    got = {r["doc_id"]: r for r in spans.cut_repeats(docs).collect()}
    assert all(tuple(r)[2:] == (7, 8, 9) for r in got.values()) and set(got) == {1, 2, 3, 4, 5}
    assert line in got[1]["text"] and got[2]["text"].split() == "Own three. Own four.".split() and got[3]["text"].split() == f"{long}.".split()
    assert (got[4]["text"], got[5]["text"]) == (None, "") and spans.cut_repeats(docs.limit(0)).collect() == []


def odd_texts(spark, ids="doc_id"):
    """Null and repeated ids, null and empty texts, ties and columns that clash with the operators' own."""
    words = PROSE.split()
    rows = [(k, " ".join(words[k % 7:k % 7 + 9]), "en" if k % 2 else "de") for k in range(40)] + [(3, "twice", "en"), (3, "twice", "en"), (None, PROSE, "en"), (41, None, "de"), (42, "", None)]
    return spark.createDataFrame([(i, t, g, 1, 2, "x", 0.5, 3) for i, t, g in rows], f"{ids} long, text string, lang string, id long, label int, score string, margin double, n long")


def test_language_of_odd_rows(spark):
    docs = odd_texts(spark)
    out = langid.predict(docs, langid.learn_dictionaries(docs))
    rows = out.collect()
    assert len(rows) == docs.count() and {r["lang_pred"] for r in rows if r["doc_id"] in (41, 42)} == {"und"}
    assert langid.predict(docs.limit(0), {}).collect() == [] and langid.learn_dictionaries(docs.limit(0)) == {}
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    same = {"b": b"the quick brown fox", "a": b"the quick brown fox"}
    assert {r["lang_pred"] for r in langid.predict(docs.filter("text = 'twice'"), same).collect()} == {"a"}  # a tie goes to the first name


def test_classifier_of_odd_rows(spark):
    """Conflicting labels count as 0, whatever their order; one class or none scores one half."""
    docs = odd_texts(spark)
    labels = [(k, k % 2) for k in range(0, 40)] + [(3, 0), (None, 1), (99, 1), (5, None)]
    marks = lambda rows: spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, quality int, id int")
    scores = [sorted((str(r["doc_id"]), r["score"], r["predicted"]) for r in nbsvm.score(docs, nbsvm.fit(docs, marks(rows))).collect()) for rows in (labels, labels[::-1])]
    assert scores[0] == scores[1] and len(scores[0]) == docs.count() and all(0 <= s <= 1 for _, s, _ in scores[0])
    for rows in ([(1, 1)], []):
        assert {(r["score"], r["predicted"]) for r in nbsvm.score(docs, nbsvm.fit(docs, marks(rows))).collect()} == {(0.5, 1)}
    assert nbsvm.score(docs.limit(0), nbsvm.fit(docs.limit(0), marks([]))).collect() == []


def test_packing_and_bytes_of_odd_rows(spark):
    """Null and repeated ids are rows of their own; every row's ids are packed once; an empty table gives nothing."""
    from public_tokenizers import PATTERN
    docs = odd_texts(spark)
    path = tokenizer_path("word_bpe_49k.json")
    out = packing.pack(docs, path, with_ids=False).collect()
    by_doc = collections.Counter(r["doc_id"] for r in out if r["start"] == 0)
    assert by_doc == collections.Counter(r["doc_id"] for r in docs.collect())
    assert packing.pack(docs.limit(0), path, with_ids=False).collect() == []
    bpe = tokenizer_path("byte_bpe_multi_50k.tiktoken")
    got = bytebpe.digest_round_trip(docs, bpe, PATTERN).collect()
    assert collections.Counter((r["doc_id"], r["decoded_sha256"]) for r in got) == collections.Counter(
        (r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in docs.collect())
    assert bytebpe.digest_round_trip(docs.limit(0), bpe, PATTERN).collect() == []
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_html_deep_nesting():
    assert html.blocks("<div class=ad>" * 20_000 + PARA) == [(html.OPEN, MAIN)]


def test_html_repeats_at_any_batch_size(spark):
    """A run on two pages of many is found however the host is cut; one on a page of another host is not."""
    shared = " ".join(f"shared{k}" for k in range(9))
    own = [" ".join(f"own{k}x{i}" for i in range(12)) for k in range(40)]
    rows = [(k, "http://h.org/" if k < 39 else "http://other.org/", f"<body><p>{o}</p>" + (f"<p>{shared}</p>" if k in (3, 38, 39) else "") + "</body>")
            for k, o in enumerate(own)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for size in (1, 700, 1 << 23):
        got = {r["page_id"]: (r["text"], r["n_repeated"]) for r in html.extract(pages, shard_bytes=size).collect()}
        assert got == {k: (o + " " + shared, 0) if k == 39 else (o, 9 * (k in (3, 38))) for k, o in enumerate(own)}


def test_html_runs_that_share_leading_bits_are_told_apart(spark, monkeypatch):
    """Whatever number of leading bits is sent first, the answers are those of whole hashes."""
    own = [" ".join(f"own{k}x{i}" for i in range(30)) for k in range(30)]
    rows = [(k, "http://h.org/", f"<body><p>{o}</p>" + f"<p>{own[0]}</p>" * (k == 7) + "</body>") for k, o in enumerate(own)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    for least, spare in ((1, -60), (6, -60), (36, 6), (64, 0)):
        monkeypatch.setattr(html, "PRINT_BITS", least)
        monkeypatch.setattr(html, "SPARE_BITS", spare)
        for size in (500, 1 << 23):
            got = {r["page_id"]: r["n_repeated"] for r in html.extract(pages, shard_bytes=size).collect()}
            assert got == {k: 30 * (k in (0, 7)) for k in range(30)}


def test_html_sends_few_bytes_a_run():
    """Runs of a batch that no other page has cost some two bytes each, and what was sent is read back."""
    page = (1, "u", "h", [(html.OPEN, " ".join(f"w{i}" for i in range(200_000)))])
    blob = html._packed([page], 200_000).column(0)[0].as_py()
    b, sent = html.Batch(blob), next(html._prints(4, 36)(iter([pa.RecordBatch.from_arrays([pa.array([0]), pa.array([blob])], ["batch", "pages"])])))
    assert sum(len(k) for k in sent.column(2).to_pylist()) < 3.5 * len(b.keys)
    assert np.concatenate([html.unsqueezed(k) for k in sent.column(2).to_pylist()]).tolist() == (b.prints(36)[0] >> np.uint64(28)).tolist()
    for values in ([7], [0, 1, 2, 3], [0, 2**64 - 1], [5, 2**40, 2**63 + 1]):
        values = np.array(values, np.uint64)
        assert html.unsqueezed(html.squeezed(values)).tolist() == values.tolist()


def test_html_strips_inside_articles(spark):
    """A strip on the articles of several pages goes, also from mirrors; the text of mirrors and a passage of two articles stay."""
    strip, quote = " ".join(f"share{k}" for k in range(9)), " ".join(f"quote{k}" for k in range(9))
    own = [" ".join(f"own{k}x{i}" for i in range(60)) for k in range(8)]
    own[7] = own[6]  # a mirror
    rows = [(k, "http://h.org/", f"<article><p>{o}</p>" + f"<p>{quote}</p>" * (k in (0, 1)) + f"<div>{strip}</div>" * (k != 5) + "</article>")
            for k, o in enumerate(own)]
    rows.append((8, "http://h.org/", f"<article>{strip}</article>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    for size in (1, 1 << 23):
        got = {r["page_id"]: r["text"] for r in html.extract(pages, shard_bytes=size).collect()}
        assert got == {8: strip} | {k: f"{o} {quote}" if k in (0, 1) else o for k, o in enumerate(own)}


@pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables are absent")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare(spark, connect(SMOKE), SMOKE, catalog.QUERIES[name], catalog.ORACLES[name]) is None


def test_pipeline(spark):
    import corpus_pipeline
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    start = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.kept(stage(spark, docs, SMOKE), "stage")
        assert docs.columns == start and 0 < docs.count() <= before.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMOKE)
    assert {r[0] for r in out.select("doc_id").distinct().collect()} == {r[0] for r in docs.select("doc_id").collect()}
    assert {*catalog.QUERIES, "pipeline"} <= set(entry_module.queries())


def test_chat_query_reads_the_loss_mask(spark, monkeypatch):
    """The loss of op9 is what the mask covers: without its spans nothing is left of it."""
    whole = chat.format_turns
    run = catalog.QUERIES["op9_chat_formatting"]
    assert run(spark, SMOKE).filter("loss_chars > 0").count() > 0
    monkeypatch.setattr(chat, "format_turns", lambda *a, **k: whole(*a, **k).withColumn("loss_mask", F.slice("loss_mask", 1, 0)))
    assert run(spark, SMOKE).filter("loss_chars > 0").count() == 0
