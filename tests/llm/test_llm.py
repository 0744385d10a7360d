import datetime as dt
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake.functions.arrowtext import string_parts
from strandlake.llm import components, encode, leaks, longtext, packing, spam, topn


# --- top n ---------------------------------------------------------------------------------------------------------


def best_by_hand(rows, n):
    latest = {}
    for hit, qid, score, length, at in rows:
        if hit not in latest or at > latest[hit][3]:
            latest[hit] = (qid, score, length, at)
    groups = defaultdict(list)
    for hit, (qid, score, length, _) in latest.items():
        if qid is not None and score is not None and score == score:
            groups[qid].append((-score, -length if length is not None else 1, hit))
    return {(q, h) for q, own in groups.items() for _, _, h in sorted(own)[:n]}


@pytest.mark.parametrize("row_group_bytes", [1, 1 << 20])
def test_top_n(spark, row_group_bytes):
    rng, t0, rows = random.Random(1), dt.datetime(2024, 1, 1), []
    for k in range(4000):
        qid = None if rng.random() < 0.02 else "hot" if rng.random() < 0.4 else f"q{rng.randint(0, 300)}"
        score = rng.choice([None, float("nan"), 0.5, 0.5, round(rng.random(), 2), round(rng.random(), 2)])
        rows.append((k % 3500, qid, score, rng.choice([None, 10, 20]), t0 + dt.timedelta(seconds=k)))
    df = spark.createDataFrame(rows + rows[:50], "hit_id long, qid string, score double, match_len int, loaded_at timestamp_ntz").withColumn("g", F.lit("clash"))
    now = topn.latest_rows(df, "hit_id", "loaded_at", ["score", "match_len", "qid"])
    got = topn.top_n(now, "qid", "score", "match_len", "hit_id", 10, row_group_bytes).collect()
    assert len(got) == len(set(map(tuple, got))) and set(map(tuple, got)) == best_by_hand(rows, 10)


def test_top_n_reads_over_all_cores(spark):
    """One group in hundreds of row groups: no task has most of them, and those below the floor aren't named at all."""
    df = spark.range(300_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 997)).alias("q"), (F.col("id") % 9973).cast("double").alias("s"), F.lit(1).alias("t"), "id")
    before = {s.stageId() for s in stages(spark)}
    got = topn.top_n(df, "q", "s", "t", "id", 5, 16 << 10)
    assert got.where("q = 'hot'").count() == 5 and got.count() == 5 * 998
    tasks = [s.numTasks() for s in stages(spark) if s.stageId() not in before]
    assert sum(n >= 2 * spark.sparkContext.defaultParallelism for n in tasks) >= 2
    best = df.where("q = 'hot'").orderBy(F.desc("s"), "id").limit(5).collect()
    assert {r.id for r in got.where("q = 'hot'").collect()} == {r.id for r in best}


def stages(spark):
    store = spark.sparkContext._jsc.sc().statusStore()
    return list(spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)))


def test_top_n_empty(spark):
    df = spark.createDataFrame([], "hit_id long, qid string, score double, match_len int, loaded_at timestamp_ntz")
    assert topn.current_top_hits(df).collect() == []


# --- packing -------------------------------------------------------------------------------------------------------


def test_sum_of_squares():
    rng = np.random.default_rng(0)
    for capacity in (10, 100, 1000):
        sizes = rng.integers(0, capacity + 1, 500)
        bins = packing.pack_block(sizes, capacity)
        assert np.bincount(bins, weights=sizes).max() <= capacity
        assert len(np.unique(bins)) == bins.max() + 1 <= 1.1 * max(sizes.sum() / capacity, (sizes > capacity / 2).sum()) + 2
    assert packing.pack_block(np.zeros(3, np.int64), 5).tolist() == [0, 0, 0] and len(packing.pack_block(np.zeros(0, np.int64), 5)) == 0
    assert packing.pack_block(np.array([5, 5, 0]), 5).tolist() == [0, 1, 0]


def test_each_step_takes_the_smallest_sum_of_squares():
    rng = np.random.default_rng(3)
    capacity, sizes = 12, rng.integers(1, 13, 200)
    fill = {}
    for s, b in zip(sizes.tolist(), packing.sum_of_squares(sizes, capacity).tolist()):
        def total(bins):
            gaps = [capacity - f for f in bins.values() if f < capacity]
            return sum(gaps.count(g) ** 2 for g in set(gaps))
        ways = [total(fill | {c: fill[c] + s}) for c in fill if fill[c] + s <= capacity] + [total(fill | {-1: s})]
        fill[b] = fill.get(b, 0) + s
        assert total(fill) == min(ways) and fill[b] <= capacity


def test_gaps_that_occur_only_give_the_same_bins():
    rng = np.random.default_rng(4)
    for capacity in (1, 7, 60, 500):
        for sizes in (rng.integers(0, capacity + 1, 300), -np.sort(-rng.integers(0, capacity + 1, 300))):
            assert np.array_equal(packing.sum_of_squares(sizes, capacity), packing.sum_of_squares(sizes, capacity, dense=0))
    great = rng.integers(1, 10**9, 2000)
    bins = packing.pack_block(great, 10**9)
    assert np.bincount(bins, weights=great).max() <= 10**9 and bins.max() + 1 < 1.1 * great.sum() / 10**9


@pytest.mark.parametrize("block", [40, 20_000])
def test_packed_jobs(spark, block):
    rng, at = random.Random(2), dt.datetime(2024, 1, 1)
    rows = [(k, 0 if k % 3 == 0 else k % 4 + 1, None if k % 5 else rng.randint(1, 250), "A" * rng.randint(1, 90), at) for k in range(400)]
    rows += rows[:30] + [(None, 1, 5, "A", at), (900, None, 5, "A", at), (901, 9, None, None, at), (902, 9, 0, "", at)]
    seqs = spark.createDataFrame(rows, "run_index long, job_id long, seqlens int, seq string, loaded_at timestamp_ntz").withColumn("size", F.lit("clash"))
    marks = [(0, "start", 100), (0, "start", None), (0, "end", 7), (1, "start", 120), (2, "start", 90), (3, "start", 100), (4, "middle", 100)]
    got = packing.pack_sequences(seqs, spark.createDataFrame(marks, "job_id long, stage string, res_per_batch int"), 6000, block).toPandas()
    want = {r[0]: (r[1], r[2] if r[2] is not None else len(r[3] or "")) for r in rows if r[0] is not None and r[1] is not None}
    assert (got.groupby("run_index")["size"].sum() == [want[k][1] for k in sorted(want)]).all()
    assert (got.groupby("run_index")["job_id"].first() == [want[k][0] for k in sorted(want)]).all()
    fill = got.groupby(["job_id", "batch_no"]).agg(s=("size", "sum"), c=("capacity", "first")).reset_index()
    assert (fill.s <= fill.c).all() and not got.duplicated(["run_index", "part"]).any()
    assert (fill.groupby("job_id").batch_no.max() == fill.groupby("job_id").batch_no.count()).all()
    split = got.groupby("run_index").part.max()
    assert all((n > 1) == (want[k][1] > got[got.run_index == k].capacity.iloc[0]) for k, n in split.items())
    if block > 400:
        assert (fill.groupby("job_id").s.sum() / fill.groupby("job_id").c.sum()).drop([4, 9]).min() > 0.93


def test_packing_of_nothing(spark):
    seqs = spark.createDataFrame([], "run_index long, job_id long, seqlens int, seq string, loaded_at timestamp_ntz")
    assert packing.pack_sequences(seqs, spark.createDataFrame([], "job_id long, stage string, res_per_batch int")).collect() == []


# --- connected groups ----------------------------------------------------------------------------------------------


def groups_by_hand(rows):
    up = {}
    clean = lambda x: None if x is None else x.strip(" ").upper()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in ((clean(a), clean(b)) for a, b in rows):
        for x in (a, b):
            if x is not None:
                up.setdefault(x, x)
        if a is not None and b is not None and find(a) != find(b):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {(x, find(x)) for x in up}


def test_groups_of_every_shape(spark):
    rng, name = random.Random(3), lambda k: f"n{k:05d}"
    rows = []
    chain, ring = rng.sample(range(100), 100), rng.sample(range(1000, 1033), 33)
    rows += [(name(a), name(b)) for a, b in zip(chain, chain[1:])] + [(name(a), name(b)) for a, b in zip(ring, ring[1:] + ring[:1])]
    rows += [(name(3000), name(3001 + k)) for k in range(60)]
    rows += [(name(rng.randrange(5000, 5060)), name(rng.randrange(5000, 5060))) for _ in range(250)]
    rows += [(name(rng.randrange(6000, 6200)), name(rng.randrange(6000, 6200))) for _ in range(210)]
    rows += [(name(7000), name(7001)), (name(7001), name(7000)), (name(7002), None), (None, None), (name(7003), name(7003)), (f" {name(7004)}  ", name(7005).upper()), ("", "z"), (None, "é")]
    for k in range(3):
        rows += [(name(9000), name(9010 + 10 * k)), (name(9010 + 10 * k), name(9011 + 10 * k)), (name(9011 + 10 * k), name(9001))]
    df = spark.createDataFrame(rows + rows[:20], "qid string, sid string").withColumn("x", F.lit(1)).withColumn("u", F.lit(2))
    got = list(map(tuple, components.connected_groups(df).collect()))
    assert len(got) == len(set(got)) and set(got) == groups_by_hand(rows)


def test_groups_of_nothing(spark):
    assert components.connected_groups(spark.createDataFrame([], "qid string, sid string")).collect() == []


# --- encoding ------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def coder():
    return encode.Encoder(encode.vocabulary_path())


ODD = [
    None, "", " ", "  a", "a  ", "\n\n a\n", "it's 's 'stuff\t's \n's ''s don't'll x'l'll", "\u3000\u3000x \u3000 y", "a" * 300, "<|endoftext|> x", "'", " '",
    "\u0085 a\u00a0b \u200b c", "\x1c\x1d a", "été 你好 مرحبا 🙂🙂", "Ⅷ ½ 12345", "a\r\nb\r\n\r\n  c", "if x:\n        return 1\n",
]


def test_encoding_is_the_library_s(coder, spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(encode.vocabulary_path())
    library.encode_special_tokens = True
    texts = ODD + [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").collect()]
    offsets, raw = string_parts(pa.array(texts, pa.string()))
    ids, counts = coder.encode(raw, offsets)
    at = np.append(0, np.cumsum(counts))
    expected = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [e.ids for e in expected]


def test_perfect_hash(coder):
    h = coder.hash
    assert len(h.value) == len(np.unique(h.value)) == len(h.low)
    both = encode.load_ranks(encode.vocabulary_path("byte_bpe_50k.tiktoken"))[0]
    assert both == coder.ids
    long = max(coder.long.values(), key=len)
    assert all(len(w) > encode.WIDE for w in coder.long.values()) and b" responsibilities" in coder.long.values()
    words = [b"zzqqy", b" the", b"the", b"\x00the", long, *coder.long.values()]
    size = np.array([len(w) for w in words])
    got = h.find(*encode.key_words(np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size, size), size)
    assert got.tolist() == [coder.ids.get(w, -1) for w in words]
    # the same key, other bytes in the middle
    like = b" unconstitutional"[:16] + b"xx" + long[-8:]
    for text in (long, like, long[:16] + b"?" + long[16:]):
        raw = np.frombuffer(text, np.uint8)
        assert b"".join({v: k for k, v in coder.ids.items()}[i] for i in coder.encode(raw, np.array([0, len(raw)]))[0].tolist()) == text


def test_merges_are_leftmost_by_rank(coder):
    def slow(word):
        parts = [word[i : i + 1] for i in range(len(word))]
        while True:
            ranked = [(coder.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in coder.ranks]
            if not ranked:
                return [coder.ids[p] for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(0)
    for _ in range(300):
        word = "".join(rng.choice("etaoinshr aaaé") for _ in range(rng.randint(1, 40))).encode()
        assert encode.merge_bytes(word, coder.ids, coder.ranks) == slow(word)


def test_encoded_frame(spark):
    long = "word " * 600_000
    df = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 0), (1, "a b", 0), (4, long, 0)], "doc_id long, text string, ids int")
    got = encode.encode_corpus(df, "doc_id", "text").collect()
    assert len(got) == 5 and {r.doc_id: r.ids for r in got if r.doc_id < 4} == {1: [64, 275], 2: [], 3: []}
    assert len(next(r.ids for r in got if r.doc_id == 4)) == 600_001
    assert encode.encode_corpus(df.limit(0), "doc_id", "text").collect() == []


# --- leaks ---------------------------------------------------------------------------------------------------------


def leaks_by_hand(docs, items, n=12):
    words = lambda t: re.findall("[0-9a-z]+", "".join(c.lower() if c.isascii() else " " for c in t or ""))
    grams = defaultdict(set)
    for item, prompt in items:
        w = words(prompt)
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(item)
    return {(doc, item) for doc, text in docs for w in [words(text)] for k in range(len(w) - n + 1) for item in grams.get(tuple(w[k : k + n]), ())}


def test_leaks_in_the_tables(spark, data):
    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    expected = leaks_by_hand(docs.select("doc_id", "text").collect(), items.select("item_id", "prompt").collect())
    for most in (50_000, 30):
        got = list(map(tuple, leaks.find_leaks(docs, items, max_items=most).collect()))
        assert len(got) == len(set(got)) and set(got) == expected and expected


def test_leak_edges_and_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    items = spark.createDataFrame([(1, passage.upper().replace(" ", ", ")), (2, passage), (3, "too short"), (4, None), (None, passage)], "item_id long, prompt string")
    half = " ".join(passage.split()[:6])
    docs = [
        (1, f"ééé {passage.replace(' ', chr(10))} end", "p"), (2, half, "p"), (3, " ".join(passage.split()[6:]), "p"), (4, None, "p"), (5, "", "p"), (6, "x" + passage, "p"),
        (7, passage[:-1], "p"), (8, "w " * 1_500_000 + passage, "p"), (1, f"ééé {passage.replace(' ', chr(10))} end", "p"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    plain = df.drop("item_id")
    assert sorted(map(tuple, leaks.find_leaks(df, items).collect())) == [(1, 1), (1, 2), (8, 1), (8, 2)]
    cut = {r.doc_id: r.text for r in leaks.remove_leaks(plain, items).collect()}
    assert cut[1] == "ééé  end" and cut[8] == "w " * 1_500_000 and cut[6] == "x" + passage and cut[4] is None and len(cut) == 8
    assert sorted(r.doc_id for r in leaks.remove_leaks(df, items, how="documents").collect()) == [2, 3, 4, 5, 6, 7]
    assert leaks.find_leaks(df.limit(0), items).collect() == [] and leaks.find_leaks(df, items.limit(0)).collect() == []


def slow_windows(raw, prompts, n=12):
    words = [(m.start(), m.end(), m.group().lower()) for m in re.finditer(rb"[0-9A-Za-z]+", raw)]
    known = {tuple(w[k : k + n]) for p in prompts for w in [re.findall(rb"[0-9a-z]+", p.lower().encode())] for k in range(len(w) - n + 1)}
    return {(words[k][0], words[k + n - 1][1]) for k in range(len(words) - n + 1) if tuple(w for _, _, w in words[k : k + n]) in known}


def test_leaks_in_texts_of_any_length(monkeypatch):
    """Words far apart, words longer than a piece, and pieces of every size: as in one pass."""
    passage = [f"w{k}" for k in range(12)]
    index = leaks.LeakIndex([(1, " ".join(passage))])
    apart = ("x " * 1_000_000 + " ".join(passage[:6]) + "é" * 2_250_000 + " ".join(passage[6:]) + " y" * 100).encode()
    raw = np.frombuffer(apart, np.uint8)
    assert len(list(index.scan(raw, np.array([0, len(raw)])))) == 1
    rng = random.Random(5)
    for size in (7, 40, 300):
        monkeypatch.setattr(leaks, "SLICE_BYTES", size)
        giant = "q" * 200
        prompts = [" ".join(passage), " ".join(passage[3:] + ["z"] * 4), giant[:90] + " " + " ".join(passage)]
        index = leaks.LeakIndex([(k, p) for k, p in enumerate(prompts)])
        for _ in range(20):
            text = ""
            for _ in range(80):
                text += rng.choice([" ".join(passage), " ".join(passage[:5]), " ".join(passage[5:]), "z z z z", giant, giant[:90], "é" * rng.randint(1, 60), "a"]) + rng.choice([" ", "\n", "", " - "])
            raw = np.frombuffer(text.encode(), np.uint8)
            got = [(x, y) for _, _, x, y in index.scan(raw, np.array([0, len(raw)]))]
            assert len(got) == len(set(got)) and set(got) == slow_windows(text.encode(), prompts)


def test_items_in_blocks(spark):
    """Spans of items in different blocks overlap: the text is cut as in one pass. Long prompts come in pieces."""
    words = [f"v{k}" for k in range(40)]
    prompts = [" ".join(words[:14]), " ".join(words[9:25]), " ".join(words[20:]), " ".join(f"p{k}" for k in range(3000))]
    items = spark.createDataFrame(list(enumerate(prompts)), "item_id long, prompt string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words) + " b"), (2, " ".join(f"p{k}" for k in range(1490, 1520))), (3, None), (4, "")], "doc_id long, text string")
    whole = [leaks.remove_leaks(docs, items).collect(), leaks.find_leaks(docs, items).collect()]
    for limits in ({"max_items": 1}, {"max_bytes": 6000}):
        assert sorted(leaks.remove_leaks(docs, items, **limits).collect(), key=str) == sorted(whole[0], key=str)
        assert sorted(leaks.find_leaks(docs, items, **limits).collect()) == sorted(whole[1]) == [(1, 0), (1, 1), (1, 2), (2, 3)]
    assert {r.doc_id: r.text for r in whole[0]} == {1: "a  b", 2: "", 3: None, 4: ""}


# --- keyword and link pages ----------------------------------------------------------------------------------------

PROSE = "This module will align the faded gate whenever a filter is split enough for the garden in use. "
SPAM = {
    "links": "# Links\n" + "\n".join(f"* [Fata lamp](https://site{k}.example/a/{k}.html)" for k in range(40)),
    "farm": "<html><body>\n" + "\n".join(f'<a href="https://x{k}.test/y/{k}">buy essay</a> | ' for k in range(40)) + "\n</body></html>",
    "urls": "\n".join(f"http://www.site{k}.test/page/{k}" for k in range(40)),
    "tags": "\n".join("cheap Fata lamp, best Fata lamp, online Dora case, sale Dora case, " * 3 for _ in range(6)),
    "one line": "fenna nelły fenna latolim nelły latolim vorstana " * 30,
    "towns": "\n".join(f"casino shipping Town{chr(97 + k % 26)}{chr(98 + k % 20)}ville" for k in range(40)),
    "hidden": "<html><head><meta name=\"keywords\" content=\"" + "Tirba,hosting,Sata," * 40 + "\"></head><body><div style=\"display:none\">" + "Sata fast hosting best Tirba " * 40 + "</div></body></html>",
}
REAL = {
    "prose": (PROSE * 4 + "\n\n") * 5,
    "prose with links": "\n".join(PROSE + f"See [guide](https://a.example/{k}) for more of it." for k in range(10)),
    "code": "\n".join(f"def f{k}(value, other={k}):\n    result = [x * {k} for x in value if x > other]\n    return result[0] + {k}\n" for k in range(20)),
    "csv": "\n".join(f"name{chr(97 + k % 26)}{chr(97 + k % 7)},{k * 37 % 999},0.{k % 1000:03d}" for k in range(60)),
    "defines": "/* written by tools/gen; edits get lost */\n\n" + "\n".join(f"#define Unit_{k} {k * 37 % 299}" for k in range(50)),
    "constants": "# made by gen. Do not edit.\n" + "\n".join(f"Target{k} = {k * 53 % 307}" for k in range(50)),
    "table": "step,level,stack,batch\n" + "\n".join(f"ka{chr(97 + k % 26)}mongal,{k * 7919 % 9973},{w},0.{k * 271 % 997:03d}" for k, w in enumerate(["raft", "ledger", "copper", "cursor", "raft"] * 12)),
    "tabs": "\n".join(f"{k * 31 % 997}\tvalley\t{k * 17 % 89}.{k % 10}\tlow" for k in range(60)),
    "shell": "#!/bin/sh\nset -eu\n" + "\n".join(f'if [ -z "$queue{chr(97 + k)}" ]; then\n  exit {k * 19}\nfi' for k in range(8)),
    "badges": "# Lona\n" + " ".join(f"![cov](http://img.example/{k}/a/badge/long/address)" for k in range(3)) + "\n\n" + PROSE + "\n\n## Links\n\n* [socket](http://kelsa.example/747)\n",
    "french": "\n".join("Le fichier est lu une fois par jour et les données ne sont pas gardées sur le disque." for _ in range(8)),
    "japanese": "このバッファは共有されますので、書き込む前に必ず確認してください。\n値が空の場合は、次の行を読み込んでから処理を続けます。\n設定を変更したら、サービスを再起動する必要があります。\n",
    "key": "-----BEGIN KEY-----\n" + "\n".join("S6928kntUQjHC4EXsUMbu3G2" + "abZ9"[k % 4] for k in range(4)) + "\n-----END KEY-----\nSELECT a, b FROM t WHERE c = 1;\n",
    "java": "\n".join(f"    static final int Name{k} = {k * 7};" for k in range(40)),
    "css": "\n".join(f".a{k}{{margin:{k}px;color:#2{k % 10}d}}" for k in range(60)),
    "manifest": '{\n  "name": "vamon",\n  "dependencies": {\n' + ",\n".join(f'    "lib{k}": "^1.{k}.0"' for k in range(40)) + "\n  }\n}",
    "empty": "",
    "null": None,
    "blank": " \n\t\n ",
}


def page_model(docs):
    return spam.fit_line_model(spam.observe_lines(docs, "doc_id", "text"))


def test_pages(spark, data):
    names = list(SPAM) + list(REAL)
    df = spark.createDataFrame([(k, (SPAM | REAL)[n], "x") for k, n in enumerate(names)] * 2, "doc_id long, text string, menu string")
    model = page_model(spark.read.parquet(f"{data}/documents.parquet"))
    for m in (model, spam.LineModel.prior()):
        got = sorted(r.doc_id for r in spam.find_spam_pages(df, model=m).collect())
        assert [names[k] for k in got] == list(SPAM)
    assert spam.find_spam_pages(df.limit(0)).collect() == []
    labels = {names[r.doc_id]: r for r in spam.label_pages(df, model=model).collect()}
    assert labels["null"].lines == labels["blank"].lines == 0 and labels["null"].spam_share == 0.0
    assert labels["csv"].data > 0.9 * labels["csv"].spam_share + 0.5 * len(REAL["csv"].replace("\n", ""))


def test_model_is_fitted_on_all_documents(spark):
    """Short and long documents, many with one key: the model is that of one pass over all of them."""
    texts = [PROSE, "cheap lamp best lamp " * 40, "x = f(1);\n" * 30, "", None, PROSE * 400, "Home\nNews\nAbout us\n" * 2_000] * 30
    df = spark.createDataFrame([(1 if k % 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = page_model(df)
    raw = [t.encode() for t in texts if t is not None]
    ends = np.append(0, np.cumsum([len(t) for t in raw]))
    text, _, seen = spam.LineScanner().scan(np.frombuffer(b"".join(raw), np.uint8), ends)
    expected = spam.LineModel.prior()
    for _ in range(spam.FIT_ROUNDS):
        expected = spam.LineModel.refitted(expected.expected(text, spam.pack(seen)))
    for a, b in ((got.first, expected.first), (got.step, expected.step), (got.emission, expected.emission)):
        assert np.allclose(a, b, atol=1e-6)


def test_a_fit_stays_near_its_prior(spark):
    """A corpus of one kind of line only, for which no state was made, changes no probability by more than the bound."""
    df = spark.createDataFrame([(k, "\n".join(f"zz{j * k}q zz{j}q" for j in range(200))) for k in range(1, 40)], "doc_id long, text string")
    got, prior = page_model(df), spam.LineModel.prior()
    for a, b in ((got.first, prior.first), (got.step, prior.step), (got.emission, prior.emission)):
        assert np.abs(np.log(a / b)).max() < np.log(spam.MOST_DRIFT) + 1e-6
    assert np.allclose(got.emission.sum(axis=1), len(spam.FIELDS)) and np.allclose(got.step.sum(axis=1), 1) and not np.allclose(got.emission, prior.emission, atol=1e-3)


def random_lines(rng, n):
    return {f: rng.integers(0, k, n).astype(np.int8) for f, k in spam.FIELDS.items()}


def test_viterbi_and_expected_counts_against_all_ways():
    model, k = spam.LineModel.prior(), len(spam.STATES)
    code = spam.pack(random_lines(np.random.default_rng(0), 8))
    text = np.array([0, 0, 0, 0, 1, 2, 2, 2])
    got = model.label(text, code)
    score = model.likelihood(code)
    first, step = np.zeros(k), np.zeros((k, k))
    for t in range(3):
        at = np.flatnonzero(text == t)
        ways = {s: np.log(model.first[s[0]]) + sum(score[i, c] for i, c in zip(at, s)) + sum(np.log(model.step[a, b]) for a, b in zip(s, s[1:])) for s in np.ndindex(*[k] * len(at))}
        assert got[at].tolist() == list(max(ways, key=ways.get))
        total = sum(np.exp(w) for w in ways.values())
        for s, w in ways.items():
            p = np.exp(w) / total
            first[s[0]] += p
            for a, b in zip(s, s[1:]):
                step[a, b] += p
    counts = model.expected(text, code)
    assert np.allclose(counts[:k], first) and np.allclose(counts[k : k + k * k].reshape(k, k), step)
    emitted = counts[k + k * k :].reshape(k, -1)
    assert np.isclose(emitted.sum(), 8 * len(spam.FIELDS))


def test_packed_lines_keep_their_values():
    seen = random_lines(np.random.default_rng(1), 50)
    code = spam.pack(seen)
    model = spam.LineModel.prior()
    by_field = sum(np.log(model.emission[:, a:b])[:, seen[f]].T for f, a, b in zip(spam.FIELDS, spam._FIRST, spam._FIRST[1:]))
    assert np.allclose(model.likelihood(code), by_field)


def test_long_page(spark):
    text = PROSE * 30_000
    df = spark.createDataFrame([(1, text), (2, "cheap lamp best lamp " * 100_000)], "doc_id long, text string")
    assert [r.doc_id for r in spam.find_spam_pages(df, model=spam.LineModel.prior()).collect()] == [2]


def test_long_texts_in_pieces(coder, monkeypatch):
    """Whatever the size of the pieces, the result is that of one pass."""
    rng = random.Random(8)
    words = ["word", "it's", "x=1;", "été", "你好", "\n", "\n\n  ", " ", "\t", "12", "END.\n", "https://a.test/b", "cheap"]
    text = "".join(rng.choice(words) + rng.choice(["", " ", " ", "\n"]) for _ in range(60_000))
    raw = np.frombuffer(text.encode(), np.uint8)
    whole = np.array([0, len(raw)])
    ids = coder.encode(raw, whole)[0]
    parts = list(longtext.token_pieces(raw, 3000))
    assert len(parts) > 50 and np.array_equal(np.concatenate([coder.encode(raw[a:b], np.array([0, b - a]))[0] for a, b in parts]), ids)

    scanner = spam.LineScanner()
    one = scanner.scan(raw, whole)
    monkeypatch.setattr(spam, "LONG_BYTES", 5000)
    assert len(list(longtext.line_pieces(raw, 5000))) > 30
    many = scanner.scan(raw, whole)
    assert np.array_equal(one[1], many[1]) and all(np.array_equal(one[2][f], many[2][f]) for f in spam.FIELDS)
    # lines longer than a piece: they count as one
    flat = np.frombuffer(("a line, " + text.replace("\n", " ") + "\nshort\n#tag list " + "word, other " * 3000 + "end.").encode(), np.uint8)
    many = scanner.scan(flat, np.array([0, len(flat)]))
    monkeypatch.setattr(spam, "LONG_BYTES", 4 << 20)
    one = scanner.scan(flat, np.array([0, len(flat)]))
    assert len(one[1]) == 3 and np.array_equal(one[1], many[1]) and all(np.array_equal(one[2][f], many[2][f]) for f in spam.FIELDS if f != "shape")

    passage = " ".join(f"alpha{k}" for k in range(30))
    long = (" filler" * 700 + " " + passage) * 40
    index = leaks.LeakIndex([(1, passage)])
    raw = np.frombuffer(long.encode(), np.uint8)
    plain = set((x, y) for _, _, x, y in index.scan(raw, np.array([0, len(raw)])))
    monkeypatch.setattr(leaks, "SLICE_BYTES", 1000)
    assert set((x, y) for _, _, x, y in index.scan(raw, np.array([0, len(raw)]))) == plain and len(plain) == 40 * 19


def test_labels_hold_out(spark, data):
    """The fitted model must agree with a plain word rule on documents that it wasn't fitted on."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    found = {r.doc_id for r in spam.find_spam_pages(docs).collect()}
    links = {r.doc_id for r in docs.where(F.col("text").isNotNull()).collect() if sum(map(len, re.findall(r"https?://\S+", r.text))) > 0.6 * len(r.text)}
    assert links <= found and len(found) < 0.2 * docs.count()


def test_removed_passages_in_the_tables(spark, data):
    from strandlake.llm.queries import QUERIES

    docs, items = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "eval_items"))
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    prompts = [r.prompt for r in items.collect() if r.prompt]
    got = {r.doc_id: r.text for r in QUERIES["p7_removed"](spark, data).collect()}
    assert got.keys() == texts.keys()
    for key, text in texts.items():
        if text is not None and got[key] != text:
            assert slow_windows(text.encode(), prompts) and len(got[key]) < len(text)
    leaked = {doc for doc, _ in leaks_by_hand(list(texts.items()), [(r.item_id, r.prompt) for r in items.collect()])}
    assert {k for k in texts if got[k] != texts[k]} == leaked


def test_queries_against_sql(spark, data):
    import os

    import duckdb

    from strandlake.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for name in os.listdir(data):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{data}/{name}'")
    for name, text in SQL.items():
        df = QUERIES[name](spark, data)
        columns = sorted(df.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({text}) t").fetchall()
        assert sorted(map(tuple, df.select(*columns).collect()), key=str) == sorted(want, key=str), name
