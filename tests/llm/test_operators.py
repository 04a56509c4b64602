"""Each operator against brute force on small tables with nulls, empty and long texts, ties, repeats and odd columns."""

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracetide.llm import decontaminate, graph_index, line_dedup, near_dedup, pieces, quality, suffix_dedup, suffix_lm, url_filter, warc
from tracetide.llm.shared import connected_components

SF = "/root/testdata/sf0.001"
WORDS = ["the", "of", "Erat", "ouhath,", "inanti", "whan", "erwh", "ñandú", "日本", "a1", "x!!", "onin", "therlyha", "re-st"]


def made(n=60, seed=0):
    """Texts with copies, near copies, shared lines, a null, empty and blank ones, and a long one."""
    rng = random.Random(seed)
    line = lambda k: " ".join(rng.choice(WORDS) + (str(rng.randrange(50)) if rng.random() < 0.5 else "") for _ in range(k))
    texts = {0: None, 1: "", 2: " \t ", 3: "one two", 4: "One  two", 5: line(4000)}
    common = ["  Same Line ", "same line", line(30)]
    for d in range(6, n):
        kind = d % 6
        if kind == 0 and d > 12:
            texts[d] = texts[d - 6]
        elif kind == 1 and d > 13:
            w = (texts[d - 6] or "a b c d e f").split(" ")
            w[rng.randrange(len(w))] = "changed"
            texts[d] = " ".join(w)
        else:
            texts[d] = "\n".join([line(rng.randrange(1, 40)), rng.choice(common), line(rng.randrange(0, 60))])
    return texts


def frame(spark, texts):
    rows = [(d, t, "x", 1, 2.0, "y") for d, t in texts.items()]
    return spark.createDataFrame(rows, "doc_id long, text string, id string, n_lines int, score double, bucket string")


def empty(spark):
    return frame(spark, {0: "a"}).where("false")


def test_line_dedup(spark):
    texts = made()
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(frame(spark, texts), min_docs=5).collect()}
    assert got == brute.kept_lines(texts, 5) and sum(x[1] for x in got.values()) > 10
    assert line_dedup.dedup_lines(empty(spark)).count() == 0
    twice = frame(spark, texts).union(frame(spark, texts))
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(twice, min_docs=5).collect()} == got
    assert line_dedup.dedup_lines(frame(spark, texts)).columns == ["doc_id", "text", "id", "score", "bucket", "n_lines", "n_dropped"]


def test_null_ids(spark):
    df = frame(spark, {1: "a b c d e f g", 2: "a b c d e f g"}).withColumn("doc_id", F.when(F.col("doc_id") == 1, 1))
    assert line_dedup.dedup_lines(df).count() == 2
    assert near_dedup.near_duplicates(df).count() == 2
    assert suffix_dedup.remove_repeats(df).count() == 2
    assert decontaminate.find_leaks(df, df.select(F.col("doc_id").alias("item_id"), "text")).count() == 4
    assert pieces.encode_texts(df).count() == 2
    assert suffix_lm.score_corpus(df, F.col("doc_id") == 1).count() == 2


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.org/es/1?x=/y", "https://example.org/en/12#a", "x.com/fr/", None, "http://b.com/de/", "ftp://c.com/fr/x", "http://d.org", "s://u@E.net:80/p/../q", "", "http://notexample.org/es/1"]
    df = spark.createDataFrame([(i, u, "", 1, "z") for i, u in enumerate(urls)], "page_id long, url string, html string, host int, label string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rule_table(spark, url_filter.RULES)).collect()}
    assert got == {0: ("a.example.org", "/es/1", "example.org/es/", "block"), 1: ("example.org", "/en/12", "example.org/en/1", "block"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("b.com", "/de/", "com/de/", "block"), 5: ("c.com", "/fr/x", "com/fr/", "allow"), 6: ("d.org", "", None, "allow"), 7: ("u@e.net:80", "/p/../q", None, "allow"), 8: ("", "", None, "allow"), 9: ("notexample.org", "/es/1", "org/", "allow")}


def test_blocks_reach_aliases(spark):
    page = lambda to: f"<html><head><LINK href='{to}' rel=canonical></head>"
    refresh = "<meta http-equiv='refresh' content='0; url=http://b.com/de/1'>"
    rows = [(1, "http://a.net/x", page("http://b.com/de/1")), (2, "http://b.com/de/1", ""), (3, "http://c.net/y", refresh), (4, "http://d.net/z", page("http://a.net/x")), (5, "http://e.net/", None), (6, "https://www.a.net/x/?utm_source=q#f", ""), (7, "http://k.com/fr/", page("http://a.net/x"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df.where("page_id < 7"), rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "block"}
    got = {r.page_id: r.verdict for r in url_filter.filter_urls(df, rules).collect()}
    assert got == {1: "allow", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "allow", 7: "allow"}
    assert url_filter.filter_urls(df.where("false"), rules).count() == 0


def test_link_targets_are_resolved_and_both_ends_alike(spark):
    html = """<head><link rel="alternate" href="/no"><link data-href="/no2" rel='x canonical' href='../p/./q?a=1&amp;b=2#f'>
    <LINK REL=canonical HREF=//H2.com/z/><meta http-equiv=Refresh content="3; URL='?x=1'"><link rel="not-canonical" href="/no3"><link rel=canonical href="mailto:a@b"><link rel=canonical href="#top"></head>"""
    rows = [(1, "HTTP://a.net/d/e/f?y", html), (2, "http://www.a.net/d/p/q?b=2&a=1", ""), (3, "https://h2.com/z?utm_source=1", None), (4, "http://a.net/d/e/f?x=1", ""), (5, "http://a.net/no", ""), (6, "http://a.net/no3", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r.a, r.b) for r in url_filter.link_edges(df.where("page_id = 1")).collect()}
    assert {b for _, b in edges} == {"https://a.net/d/e/f?y", "https://a.net/d/p/q?a=1&b=2", "https://h2.com/z", "https://a.net/d/e/f?x=1"}
    plain = {r.b for r in url_filter.link_edges(df.where("page_id = 1"), canonical_forms=False).collect()}
    assert plain == {"http://a.net/d/e/f?y", "http://a.net/d/p/q?a=1&b=2", "http://h2.com/z/", "http://a.net/d/e/f?x=1"}
    out = url_filter.filter_urls(df.withColumns({"component": F.lit("x"), "label": F.lit(1)}), url_filter.rule_table(spark, url_filter.RULES)).select("page_id", "host", "path", "rule", "verdict", "component")
    import duckdb

    pages = df.toPandas()  # noqa: F841
    want = duckdb.sql(url_filter.ORACLE).df().sort_values("page_id").astype(object)
    assert out.orderBy("page_id").toPandas().astype(object).where(lambda x: x.notna(), None).values.tolist() == want[out.columns].where(lambda x: x.notna(), None).values.tolist()
    assert len(set(want["component"])) == 3


def test_components_of_a_shuffled_chain(spark):
    order = list(range(2000))
    random.Random(8).shuffle(order)
    df = spark.createDataFrame([(order[k], order[k + 1]) for k in range(1999)], "a long, b long")
    assert {r.label for r in connected_components(df).collect()} == {0}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)] + [(200, k) for k in range(201, 260)] + [(None, 1), (5, 5)]
    label = {x: x for e in edges for x in e if x is not None and e[0] is not None and e[0] != e[1]}
    for _ in label:
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long")
    assert {r.node: r.label for r in connected_components(df).collect()} == label


def test_near_duplicates(spark):
    texts = made(150, 3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    want = brute.near_classes(texts)
    assert got == want and sum(not x[2] for x in want.values()) > 10
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("parts", [1, 13])
def test_near_duplicates_lose_no_link_in_crowded_buckets(spark, parts):
    """Families at 85 % among members of one template at 70 to 84 %, in any partitioning; short texts as well."""
    rng = random.Random(41)
    word = lambda: f"w{rng.randrange(10**7)}"
    base, texts = [word() for _ in range(220)], {}
    for d in range(120):
        own = base[:180] + [word() for _ in range(40)]
        for k in range(2):
            copy = own.copy()
            copy[rng.randrange(180, 220)] = word()
            texts[3 * d + k] = " ".join(copy)
        texts[3 * d + 2] = " ".join(own[:rng.randrange(150, 220)])
    for d in range(400, 520):
        short = [rng.choice("ab") + str(rng.randrange(2)) for _ in range(rng.randrange(4, 30))]
        texts[d] = " ".join(short)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(frame(spark, texts).repartition(parts)).collect()}
    assert got == brute.near_classes(texts)


def test_near_duplicates_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == brute.near_classes(texts)


def test_tiles_of_one_bucket_meet():
    """Two tiles that meet give the links of a whole bucket."""
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.choice(np.arange(1, 400, dtype=np.uint64) * np.uint64(2**55 + 12345), 300, replace=False)) for _ in range(6)]
    sets += [np.sort(np.append(s[:-3], rng.integers(1, 2**62, 3, dtype=np.uint64))) for s in sets]
    sig = [near_dedup.signature(s).tobytes() for s in sets]
    import pyarrow as pa

    n = len(sets)
    rows = pa.table({"bucket": [1] * n, "low": [0] * n, "high": [1] * n, "tile": [0] * 6 + [1] * 6, "band": [near_dedup.BANDS] * n, "doc": range(n), "n": [len(s) for s in sets], "label": range(n), "sig": sig, "shingles": [s.tobytes() for s in sets]})
    assert sorted(near_dedup._meeting(rows, 85, near_dedup.least_agreement(85))) == [(k, k + 6) for k in range(6)]


def test_chains_of_near_copies_are_one_class(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = {}
    for d in range(60):
        texts[d] = " ".join(words)
        words[rng.randrange(200)] = f"v{d}"
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(frame(spark, texts)).collect()}
    assert got == {d: x[1] for d, x in brute.near_classes(texts).items()}


@pytest.mark.parametrize("bucket", [1 << 20, 1 << 12])
def test_suffix_dedup(spark, bucket):
    texts = made(50, 5)
    texts[50], texts[51], texts[52] = "ab" * 400, "a" * 333, "a" * 333
    df = frame(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(df, bucket_bytes=bucket).collect()}
    assert got == brute.repeated_strings(texts) and sum(x[1] for x in got.values()) > 1000
    assert suffix_dedup.remove_repeats(empty(spark)).count() == 0


def test_repeated_rows_repeat_each_other(spark):
    text = "x y z " * 5 + "q" * 150
    df = frame(spark, {1: text})
    got = suffix_dedup.remove_repeats(df.union(df)).collect()
    assert sorted(r.n_removed for r in got) == [brute.repeated_strings({1: text})[1][1], len(text)]


def test_alignment_is_smith_waterman():
    rng = random.Random(6)
    for _ in range(50):
        a, b = [rng.randrange(5) for _ in range(rng.randrange(1, 30))], [rng.randrange(5) for _ in range(rng.randrange(1, 20))]
        assert decontaminate.align(np.array(a, np.uint64), np.array(b, np.uint64))[0] == brute.best_alignment(a, b)


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_GRAMS, 0])
def test_decontamination(spark, limit):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(400)}"
    items = {k: [word() for _ in range(rng.randrange(12, 50))] for k in range(12)} | {12: ["short", "one"], 13: []}
    texts = {}
    for d in range(80):
        body = [word() for _ in range(rng.randrange(5, 120))]
        if d % 4 == 0:
            leak = list(items[d // 4 % 13])
            for _ in range(len(leak) // 12):
                leak[rng.randrange(len(leak))] = "edited"
            at = rng.randrange(len(body))
            body[at:at] = leak
        texts[d] = " ".join(body)
    texts |= {80: None, 81: "", 82: texts[0]}
    bench = spark.createDataFrame([(k, " ".join(w).upper() if k % 2 else " ".join(w)) for k, w in items.items()] + [(99, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.find_leaks(frame(spark, texts), bench, broadcast_grams=limit).collect()}
    want = {}
    for d, t in texts.items():
        for k, w in items.items():
            s = brute.best_alignment((t or "").split(), w) if w else 0
            if s and s >= decontaminate.needed(len(w)):
                want[d, k] = s
    assert got == want and len(want) >= 20
    assert decontaminate.find_leaks(empty(spark), bench).count() == 0
    assert decontaminate.find_leaks(frame(spark, texts), bench.where("false")).count() == 0


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_GRAMS, 0])
def test_decontamination_of_copies_edited_every_few_words(spark, limit):
    """Runs of five or six intact words between edits, where other documents make them the frequent ones."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(5000)}"
    items = {k: [word() for _ in range(40)] for k in range(6)}
    texts = {}
    for d in range(48):
        k = d % 6
        leak, body = list(items[k]), [word() for _ in range(60)]
        for at in (range(5, 40, 6), (6, 13, 20, 27, 34, 37))[d // 6 % 2]:
            leak[at] = f"edited{d}-{at}"
        body[30:30] = (leak, items[k][18:26], leak[:12], leak)[d // 12]
        texts[d] = " ".join(body)
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.find_leaks(frame(spark, texts), bench, broadcast_grams=limit).collect()}
    scores = {(d, k): brute.best_alignment(t.split(), w) for d, t in texts.items() for k, w in items.items()}
    assert got == {pair: s for pair, s in scores.items() if s >= decontaminate.needed(40)} and len(got) == 24


def test_most_is_an_upper_bound():
    rng = random.Random(18)
    for _ in range(50):
        a, b = [rng.randrange(9) for _ in range(rng.randrange(1, 30))], [rng.randrange(9) for _ in range(rng.randrange(1, 20))]
        assert decontaminate.most(np.array(a, np.uint64), np.array(b, np.uint64)) >= brute.best_alignment(a, b)


def test_quality(spark):
    large = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{large}/documents.parquet")
    labels = spark.read.parquet(f"{large}/labels.parquet")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (10**6, ""), (10**6, "")], "doc_id long, text string"))
    got = quality.classify(more, labels).toPandas()
    assert len(got) == more.count() and got["score"].between(0, 1).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    held = {d: zlib.crc32(str(int(d)).encode()) % 3 == 1 for d in got["doc_id"].dropna()}
    assert all(held[r.doc_id] == r.held_out for r in got.dropna().itertuples())
    both = got.merge(labels.toPandas(), on="doc_id")
    both = both[both["held_out"]]
    assert (both["predicted"] == both["quality"]).mean() > 0.9
    assert quality.classify(empty(spark), labels).count() == 0
    assert quality.classify(docs, labels.where("false")).count() == docs.count()


def test_lm_scores(spark):
    texts = made(60, 8)
    out = suffix_lm.score_corpus(frame(spark, texts), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, block_bytes=1 << 12).collect()
    tokens = {d: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + ["\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    count = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    for r in out:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws))
    assert len(out) == len(texts) and sum(r.score for r in out) > sum(r.base_score for r in out)
    assert suffix_lm.score_corpus(empty(spark), F.lit(False)).count() == 0


def test_lm_contexts_make_distributions(spark):
    """The chances of all words after a context add up to no more than 1."""
    rng = random.Random(9)
    texts = {0: " ".join(rng.choice(["a b c", "a b d", "e b f", "g"]) for _ in range(4000))}
    vocabulary = ["a", "b", "c", "d", "e", "f", "g"]
    for k, w in enumerate(vocabulary):
        texts[k + 1] = f"a b {w}"
        texts[k + 21] = "a b"
    held = F.col("doc_id") > 0
    score = {r.doc_id: r.score for r in suffix_lm.score_corpus(frame(spark, texts), held).collect()}
    end = {k: score[k + 21] for k in range(7)}
    assert len(set(end.values())) == 1
    assert score[3] > score[1] + 1  # c follows a b, a doesn't


def test_lm_keeps_contexts_of_few_occurrences_in_a_large_corpus(spark):
    rng = random.Random(19)
    texts = {d: " ".join(rng.choice("abcdef") + str(rng.randrange(9)) for _ in range(10_000)) for d in range(60)}
    for d in range(20):
        texts[d] += " rare pair"
    texts[60] = "rare pair"
    got = [r for r in suffix_lm.score_corpus(frame(spark, texts), F.col("doc_id") == 60).collect() if r.doc_id == 60]
    assert got[0].base_score < -12 and got[0].score > -6  # once rare is there, pair and the end follow


@pytest.fixture(scope="module")
def table():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


def exact(text, p):
    best = [(0.0, 0, 0)] + [(-math.inf, 0, 0)] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - p.longest), e):
            found = p.by_text.get(text[s:e]) or ((p.worst, -1 - ord(text[s])) if e - s == 1 else None)
            if found and best[s][0] + found[0] > best[e][0]:
                best[e] = best[s][0] + found[0], s, found[1]
    out, e = [], len(text)
    while e:
        out.append(best[e][2])
        e = best[e][1]
    return out[::-1]


def test_streaming_viterbi_is_exact_in_any_portions(table):
    rng = random.Random(10)
    for text in ("▁" + "therestingonthe" * 9, "▁▁▁▁abc▁d日本😀", "x" * 90, "▁" + "".join(rng.choice("theran😀 ▁") for _ in range(300))):
        stream, out, at = pieces.StreamingViterbi(table), [], 0
        while at < len(text):
            n = rng.randrange(1, 20)
            out += stream.feed(text[at : at + n])
            assert len(stream.scores) <= table.longest
            at += n
        assert out + stream.finish() == exact(text, table)


def test_many_streams_are_exact(table):
    rng = random.Random(31)
    texts = ["", "x" * 1500, "a", " ", "therestingonthe" * 70, "".join(rng.choice("theran😀 ñ") for _ in range(2500)), " ".join("".join(rng.choice("ethrsoin") for _ in range(rng.randrange(1, 30))) for _ in range(200))]
    raw = [t.encode() for t in texts]
    ids, count = pieces.Encoder(table).encode(np.append(0, np.cumsum([len(r) for r in raw])), np.frombuffer(b"".join(raw), np.uint8))
    for text, own in zip(texts, np.split(ids, np.cumsum(count)[:-1]), strict=True):
        want = exact("▁" + text.replace(" ", "▁"), table) if text else []
        assert own.tolist() == [i for x in want for i in ([x] if x >= 0 else table.bytes[list(chr(-1 - x).encode())].tolist())]


def test_unigram_models_agree_with_the_library(spark, tmp_path):
    """A model with log-probabilities and a normaliser, without byte pieces."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng = random.Random(33)
    model = pb.ModelProto()
    model.trainer_spec.model_type = 1
    model.normalizer_spec.name, model.normalizer_spec.add_dummy_prefix, model.normalizer_spec.remove_extra_whitespaces = "identity", True, True
    names = {"▁", *"abcdef▁", *("".join(rng.choice("abcdef") for _ in range(rng.randrange(2, 7))) for _ in range(60)), *("▁" + "".join(rng.choice("abcdef") for _ in range(rng.randrange(1, 5))) for _ in range(40))}
    for name, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((n, 1) for n in sorted(names))]:
        model.pieces.add(piece=name, score=-rng.random() * 9 if kind == 1 else 0.0, type=kind)
    path = tmp_path / "unigram.model"
    path.write_bytes(model.SerializeToString())
    texts = {d: "".join(rng.choice("abcdef  xé") for _ in range(rng.randrange(0, 80))) for d in range(80)} | {90: None, 91: "  ", 92: "xx aé"}
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for r in pieces.encode_texts(frame(spark, texts), model=str(path)).collect():
        assert r.ids == library.encode(texts[r.doc_id] or "")


def test_pieces_round_trip(spark, table):
    texts = made(40, 11) | {90: "a▁b", 91: "  two  spaces \n", 92: "y" * 500, 93: "\x00\x01😀" * 40}
    encoded = pieces.encode_texts(frame(spark, texts))
    rows = {r.doc_id: r for r in encoded.collect()}
    for d, r in rows.items():
        own = "▁" + texts[d].replace(" ", "▁") if texts[d] else ""
        plain = [i for x in exact(own, table) for i in ([x] if x >= 0 else table.bytes[list(chr(-1 - x).encode())].tolist())]
        assert r.ids == plain and r.n_ids == len(plain) and r.round_trip == ("▁" not in (texts[d] or ""))
    back = {r.doc_id: r.text for r in pieces.decode_texts(encoded).collect()}
    assert all(back[d] == (t or "").replace("▁", " ") for d, t in texts.items())
    assert pieces.encode_texts(empty(spark)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    texts = made(60, 12)
    texts[70] = texts[8]
    df = frame(spark, texts).select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://x/\n"), "doc_id").alias("url"), F.col("text").alias("html"), "bucket")
    df = df.union(df.where("page_id = 8"))
    runs = []
    for k, parts in enumerate((1, 7)):
        out = str(tmp_path / str(k))
        manifest = warc.write_warc(df.repartition(parts), out, shard_bytes=1 << 13, roll_bytes=1 << 11)
        files = {r.file: r.sha256 for r in manifest.collect()}
        assert len(files) > 3 and all(hashlib.sha256(open(f"{out}/{f}", "rb").read()).hexdigest() == h for f, h in files.items())
        assert gzip.open(f"{out}/{min(files)}").read().startswith(b"WARC/1.1\r\nWARC-Type: ")
        runs.append((files, sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(manifest, out).collect()), key=repr)))
    assert runs[0] == runs[1]
    last = {}
    for d, t in texts.items():
        last[t or ""] = max(d, last.get(t or "", -1))
    want = []
    for d, t in [*texts.items(), (8, texts[8])]:
        raw = (t or "").encode()
        first = last[t or ""] == d
        want.append((d, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else last[t or ""]))
    assert runs[0][1] == sorted(want, key=repr)
    none = warc.write_warc(df.where("false"), str(tmp_path / "none"))
    assert none.count() == 0 and warc.read_warc(none, str(tmp_path / "none")).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(1500, 16))
    x[100:140] = x[7]
    rows = [(i, v.tolist(), i, "q") for i, v in enumerate(x)] + [(9001, None, 1, ""), (9020, [0.0] * 16, 1, ""), (9040, [math.nan] * 16, 1, ""), (9060, [1.0, None] * 8, 1, ""), (9080, [1.0, 2.0], 1, ""), (20, x[20].tolist(), 1, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, query_id string")
    points = graph_index.usable(df, "vec_id", "embedding")
    got = graph_index.search_index(graph_index.build_index(points, 400), points.where("id % 20 = 0"), 20).toPandas()
    hits = 0
    assert set(got["query_id"]) == set(range(0, 1500, 20))
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(len(s)), -s))[:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and g["score"].to_numpy() == pytest.approx(s[g["vec_id"]])
        hits += len(set(g["vec_id"]) & set(want))
    assert hits >= 0.9 * 20 * 75
    assert graph_index.nearest(df.where("false"), "id % 20 = 0").count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        after = {r.doc_id: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "line dedup":
            want = brute.kept_lines({d: r.text for d, r in before.items()}, 10)
            assert {d: r.text for d, r in after.items()} == {d: x[2] for d, x in want.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "near dedup":
            want = brute.near_classes({d: r.text for d, r in before.items()}, 80)
            assert set(after) == {d for d, x in want.items() if x[2]}
    out = {r.doc_id: r.round_trip for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(out) == set(after) and all(out.values())


@pytest.mark.parametrize(("block", "depth", "hot"), [(1 << 12, 5, 1 << 16), (1 << 20, 2, 20), (1 << 11, 4, 20)])
def test_lm_scores_are_those_of_a_tree_in_dictionaries(spark, block, depth, hot):
    rng = random.Random(29)
    phrases = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(rng.randrange(2, 9))) for _ in range(25)]
    texts = {d: " ".join(rng.choice(phrases) if rng.random() < 0.8 else rng.choice("ABCQ") + str(rng.randrange(60)) for _ in range(rng.randrange(0, 60))) for d in range(120)}
    texts |= {200: None, 201: "", 202: texts[5], 203: " ".join(rng.choice(phrases) for _ in range(900))}
    tokens = {d: [w.lower() for w in (t or "").split()] + ["\n"] for d, t in texts.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    m = suffix_lm
    want = brute.tree_scores(tokens, held, depth, m.MIN_CONTEXT, m.MIN_NEXT, m.DISCOUNT, m.GAIN)
    got = {r.doc_id: r.score for r in m.score_corpus(frame(spark, texts), F.crc32(F.col("doc_id").cast("string")) % 7 == 2, block_bytes=block, depth=depth, hot=hot).collect()}
    assert got == {d: pytest.approx(x, rel=1e-5) for d, x in want.items()}


def test_pipeline_stages_take_odd_rows(spark):
    """Nulls, empty and repeated rows, no rows at all; clean documents stay."""
    texts = made(40, 51)
    df = frame(spark, texts).select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"))
    df = df.union(df.where("doc_id = 20")).union(df.limit(1).select(F.lit(None).cast("long"), "text", "lang", "source", "n_chars"))
    assert [c for c in df.columns] == corpus_pipeline.COLUMNS
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, df, SF)
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert None in ids and stage(spark, df.where("false"), SF).count() == 0
        if name != "pieces":
            assert out.columns == corpus_pipeline.COLUMNS
        if name in ("line dedup", "pieces"):
            assert len(ids) == len(texts) + 2
    assert corpus_pipeline.quality_stage(spark, df.where("false"), SF).columns == corpus_pipeline.COLUMNS


@pytest.mark.parametrize("blocks", range(1, 13))
def test_lm_keeps_every_document_whatever_the_blocks(spark, blocks):
    """Parts without a block, blocks that ask nothing and hot contexts change neither rows nor scores."""
    common = "the cat sat on the mat and the dog sat on the rug and so it went on. "
    texts = {i: common * 12 if i % 3 else "".join(f"word{i * 100 + k} " for k in range(150)) for i in range(24)}
    size = sum(map(len, texts.values()))
    df = frame(spark, texts).repartition(blocks % 3 + 1, "doc_id")
    one = {r.doc_id: (r.n_tokens, r.n_known, r.base_score, r.score) for r in suffix_lm.score_corpus(frame(spark, texts), F.col("doc_id") % 7 == 2, hot=100).collect()}
    got = suffix_lm.score_corpus(df, F.col("doc_id") % 7 == 2, block_bytes=-(-size // blocks), hot=100).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        assert (r.n_tokens, r.n_known) == one[r.doc_id][:2] and r.base_score == pytest.approx(one[r.doc_id][2]) and r.score == pytest.approx(one[r.doc_id][3], rel=1e-6)


def test_strings_of_the_suffix_tree_are_short_where_they_move():
    """Frequent words are small numbers, and what a context gives to its next words is told as whole quarters."""
    rng = np.random.default_rng(3)
    at, next_ = np.nonzero(rng.random((300, 400)) < 0.2)
    kept = {"word": np.arange(1, 400, dtype=np.uint64), "context": rng.integers(1, 2**63, 300).astype(np.uint64), "occurs": rng.integers(16, 4000, 300), "at": at, "next": next_, "trained": rng.integers(0, 9, len(at)), "lower": np.full(len(at), 0.002, np.float32)}
    dealt = suffix_lm.Dealt(kept, 4, 1 << 16)
    asked = dealt.ask(7)
    assert sum(len(x.as_py()) for x in asked.column("data")) < 3 * len(at)
    told = pa.concat_tables([suffix_lm._judge(asked.filter(pa.compute.equal(asked.column("bucket"), b)), False, 1 << 16) for b in range(4)])
    quarters = np.concatenate([suffix_lm.unpack(x, (np.int64, np.int64))[1] for x in told.sort_by("bucket").column("told")])
    gives = np.bincount(at, np.where(kept["trained"] >= 2, kept["trained"] - suffix_lm.DISCOUNT, 0), 300)
    assert set(quarters) - {0} and set(quarters) <= {0, *(4 * gives).astype(int)}
    n, rest = dealt.answers(told)
    retained = rest != 0
    assert (rest[retained] == 1 - gives[retained] / kept["occurs"][retained]).all()
    assert (n == np.where((kept["trained"] >= 2) & retained[at], kept["trained"], 0)).all()
