import random

import pyarrow as pa

from strandlake.operators.split_values import one_per_key, split_batch, split_values


def by_hand(text):
    out, i, pos = [], 0, 1
    while True:
        j = i
        while j < len(text) and text[j] == " ":
            j += 1
        quoted = None
        if j < len(text) and text[j] in "\"'":
            q, k, inner = text[j], j + 1, ""
            while k < len(text):
                if text[k] == q and text[k + 1 : k + 2] == q:
                    inner, k = inner + q, k + 2
                elif text[k] == q:
                    quoted, i = inner, k + 1
                    break
                else:
                    inner, k = inner + text[k], k + 1
        tail = ""
        while i < len(text) and text[i] not in "|;,\t":
            step = 2 if text[i] == "\\" and i + 1 < len(text) and text[i + 1] in "|;,\t" else 1
            tail, i = tail + text[i + step - 1], i + step
        piece = tail.strip(" ") if quoted is None else quoted + tail.rstrip(" ")
        if piece:
            out.append((pos, piece))
        if i >= len(text):
            return out
        pos, i = pos + 1, i + 1


def pieces(texts):
    rows, pos, found = split_batch(pa.array(texts, pa.string()))
    got = {}
    for r, p, s in zip(rows.to_pylist(), pos.to_pylist(), found.to_pylist()):
        got.setdefault(r, []).append((p, s))
    return [got.get(k, []) for k in range(len(texts))]


def test_against_a_character_loop():
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \"\"''|;,\t\\é") for _ in range(rng.randint(1, 16))) for _ in range(30_000)]
    assert pieces(texts) == [by_hand(t) for t in texts]


def test_stated_cases():
    assert pieces(['a; "b;c" , \'d\'\'e\'|f\\,g\t', "5'-x, y", '"open, z', None, "", ",,"]) == [
        [(1, "a"), (2, "b;c"), (3, "d'e"), (4, "f,g")],
        [(1, "5'-x"), (2, "y")],
        [(1, '"open'), (2, "z")],
        [],
        [],
        [],
    ]


def test_slices_and_long_text():
    long = ",".join(["x" * 50] * 200_000)
    got = pieces([long, "a|b"])
    assert len(got[0]) == 200_000 and got[0][-1] == (200_000, "x" * 50) and got[1] == [(1, "a"), (2, "b")]
    column = pa.array(["skip", "a,b", None, "c"]).slice(1)
    rows, pos, found = split_batch(column)
    assert list(zip(rows.to_pylist(), pos.to_pylist(), found.to_pylist())) == [(0, 1, "a"), (0, 2, "b"), (2, 1, "c")]


def test_frame_with_odd_rows(spark):
    rows = [(1, "a;b", "x"), (1, "a;b", "x"), (2, None, "y"), (3, "na", None), (4, "", "z"), (None, "q|r", "w")]
    df = spark.createDataFrame(rows, "k long, v string, piece string")
    got = sorted(map(tuple, split_values(one_per_key(df, "k", "v"), "k", "v", "t").collect()), key=str)
    assert got == sorted([("t", 1, 1, "a"), ("t", 1, 2, "b"), ("t", None, 1, "q"), ("t", None, 2, "r")], key=str)
    assert split_values(df.limit(0), "k", "v").collect() == []
