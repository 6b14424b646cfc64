import collections
import hashlib
import math
import zlib

import numpy as np
import pytest

from tessera.llm import mixing, packing, separators, token_files
from tessera.llm.common import bucket_of, ordered_bounds, shared_dir
from tessera.llm.tokens import encoder, vocabulary

ODD = [
    (5, "Hello, world. The  end"), (1, None), (3, ""), (9, " \t\n"), (7, "<|endoftext|> <|ENDOFTEXT|> it's a test's \x1c end x"), (7, "Hello, world. The  end"), (7, "Hello, world. The  end"),
    (2, "É́cole ÀÉ ßTRASSE %%%,,, 12.5 a.b,c"), (None, "no id"), (4, "word " * 5000),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", None if i == 5 else "s", "x", 1) for i, t in ODD], "doc_id long, text string, lang string, source string, start string, length int").repartition(3)


def plain_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()).encode(text or "", add_special_tokens=False).ids


def test_cached_words_encode_as_whole_texts():
    encode = encoder(vocabulary())
    for _, text in ODD[:6] + ODD[7:9]:
        assert np.frombuffer(encode((text or "").encode()), "<u4").tolist() == plain_ids(text)


def test_token_files_round_trip(spark, odd):
    path = shared_dir(spark, "t")
    token_files.write_token_files(odd, path, files=4)
    rows = sorted(token_files.document_digests(spark, path).collect(), key=lambda r: r["start"])
    want = collections.Counter()
    for doc_id, text in ODD:
        ids = np.array([*plain_ids(text), 2], "<u4")
        want[doc_id, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    # ids ascend, nulls first; rows of one id stand in any order
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()
    found = token_files.read_token_files(spark, path, [5]).collect()
    assert [list(r["ids"]) for r in found] == [[*plain_ids(ODD[0][1]), 2]]


def test_token_files_of_an_empty_table(spark, odd):
    path = shared_dir(spark, "t")
    token_files.write_token_files(odd.limit(0), path)
    assert token_files.document_digests(spark, path).count() == 0


@pytest.mark.parametrize("block_bytes", [64, 1000, 1 << 20])
def test_separators_found_across_blocks(spark, block_bytes):
    path = shared_dir(spark, "f")
    one = spark.createDataFrame(ODD, "doc_id long, text string").coalesce(1)
    separators.write_flat_files(one, path)
    rows = sorted(separators.token_counts(spark, path, block_bytes=block_bytes).collect(), key=lambda r: r["start"])
    texts = [t for _, t in ODD]
    assert [r["n_tokens"] for r in rows] == [len(plain_ids(t)) + 1 for t in texts] and all(r["closed"] for r in rows)
    assert [r["ordinal"] for r in rows] == list(range(len(texts)))


def test_separators_open_tail_and_empty_file(spark):
    ids = lambda *x: np.array(x, "<u2").tobytes()
    whole = {"a": ids(5, 2, 6, 7, 2, 8), "b": b"", "c": ids(2, 2)}
    blocks = [(f, k, b[i : i + 4]) for f, b in whole.items() for k, i in enumerate(range(0, max(1, len(b)), 4))]
    rows = separators.documents_of(separators.scan_blocks(spark.createDataFrame(blocks, "file string, block int, bytes binary"))).collect()
    got = sorted((r["file"], r["ordinal"], r["start"], r["n_tokens"], r["closed"]) for r in rows)
    assert got == [("a", 0, 0, 2, True), ("a", 1, 2, 3, True), ("a", 2, 5, 1, False), ("c", 0, 0, 1, True), ("c", 1, 1, 1, True)]


def test_sum_of_squares_places_where_the_sum_is_least():
    rng = np.random.default_rng(3)
    lengths, capacity = rng.integers(1, 33, 400), 32
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    fill: dict[int, int] = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        def cost(state):
            gaps = np.bincount([capacity - f for f in state.values() if f < capacity], minlength=capacity)
            return int((gaps.astype(int) ** 2).sum())

        options = [cost({**fill, k: f + s}) for k, f in fill.items() if f + s <= capacity] + [cost({**fill, -1: s})]
        assert fill.get(b, 0) == o
        fill[b] = o + s
        assert cost(fill) == min(options)
    assert max(fill.values()) <= capacity


def test_pieces_lie_without_gaps(spark, odd):
    rows = packing.pack_documents(odd).collect()
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    whole = {}
    for doc_id, text in ODD:
        whole[doc_id] = whole.get(doc_id, 0) + len(plain_ids(text)) + 1
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == whole
    assert packing.pack_documents(odd.limit(0)).count() == 0
    s = packing.packed_sequences(odd).collect()
    assert sum(len(r["input_ids"]) for r in s) == sum(whole.values())


def test_few_sequences(spark, small):
    rows = packing.pack_documents(spark.read.parquet(f"{small}/documents.parquet")).collect()
    least = -(-sum(r["length"] for r in rows) // 2048)
    assert len({r["sequence_id"] for r in rows}) <= least + 8


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), ("c", 30), ("d", 0)], "source_key string, size long").selectExpr("source_key", "size", "false as no_source")
    got = {r["source_key"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    weights, size, total = {"a": 5, "b": 2, "c": 1, "d": 5}, {"a": 100, "b": 1000, "c": 30, "d": 0}, 1.5 * 1130
    full: set = set()
    while True:  # shared out again until no target is above its cap
        level = (total - sum(2 * size[k] for k in full)) / sum(w for k, w in weights.items() if k not in full)
        more = {k for k in weights if k not in full and level * weights[k] > 2 * size[k]}
        if not more:
            break
        full |= more
    assert got == pytest.approx({k: 2 * size[k] if k in full else level * weights[k] for k in weights})


def test_mix_comes_near_its_targets(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = mixing.mix_documents(docs, block_words=16).drop("segments").collect()
    by = {}
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        t = by.setdefault((r["source_key"]), [0, r["target"]])
        t[0] += r["taken"]
    for taken, target in by.values():
        assert abs(taken - target) <= 0.02 * target + 3 * 16
    again = mixing.mix_documents(docs, block_words=16).drop("segments").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mix_of_odd_rows(spark, odd):
    rows = mixing.mix_documents(odd).collect()
    assert len(rows) == len(ODD) and all(r["taken"] <= 2 * r["size"] for r in rows)
    texts = mixing.mixed_texts(odd)
    assert texts.columns == odd.columns
    assert sum(len((r["text"] or "").encode().split()) for r in texts.collect()) == sum(r["taken"] for r in rows)
    assert mixing.mix_documents(odd.limit(0)).count() == 0 and mixing.mixed_texts(odd.limit(0)).count() == 0


def brute_permuted(i, n, key):
    wide = math.isqrt(n - 1) + 1 if n > 1 else 1
    tall = n // wide
    for half in (0, 1):
        row, col = divmod(i, wide)
        for k in range(4):
            f = lambda x: ((x * mixing.FACTOR + key * (4 * half + k + 1) * 7919 % mixing.PRIME) % mixing.PRIME) ** 2 % mixing.PRIME
            if k % 2 == 0:
                row = (row + f(col)) % max(tall, 1)
            else:
                col = (col + f(row)) % wide
        i = row * wide + col if i < tall * wide else i
        i = i if half else (i + key) % n
    return i


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 3, 10, 997, 1024, 5000):
        rows = mixing.permuted(spark.range(n), F.col("id"), F.lit(n), mixing.draw("k", n), "p")
        got = {r["id"]: r["p"] for r in rows.collect()}
        assert sorted(got.values()) == list(range(n)) and rows.columns == ["id", "p"]
        key = int(hashlib.md5(f"k:{n}".encode()).hexdigest()[:8], 16)
        assert got == {i: brute_permuted(i, n, key) for i in range(n)}
    # neighbours do not keep a stride
    steps = {got[i + 1] - got[i] for i in range(4999)}
    assert len(steps) > 2000
    big = 3 << 40
    far = [r["p"] for r in mixing.permuted(spark.range(big - 1000, big), F.col("id"), F.lit(big), F.lit(12345), "p").collect()]
    assert len(set(far)) == 1000 and all(0 <= x < big for x in far)


def test_shard_counts_are_multinomial_and_meet_the_totals(spark):
    targets = spark.createDataFrame([(1, 3000), (2, 900), (3, 100), (4, 0)], "source_no int, slots long")
    rows = mixing.shard_counts(targets, 100).collect()
    by, shards = {}, {}
    for r in rows:
        by.setdefault(r["source_no"], {})[r["shard"]] = r["slots"]
        shards[r["shard"]] = shards.get(r["shard"], 0) + r["slots"]
    assert {s: sum(c.values()) for s, c in by.items()} == {1: 3000, 2: 900, 3: 100} and set(shards.values()) == {100} and len(shards) == 40
    # the variance of a multinomial, not of one stratum a slot
    spread = np.var([by[1][s] for s in shards])
    assert 8 < spread < 45


def test_buckets_follow_the_order(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"))
    bounds = ordered_bounds(df, "k", 50)
    rows = df.select("k", bucket_of(F.col("k"), bounds).alias("b")).orderBy("k").collect()
    assert [r["b"] for r in rows] == [sum(b <= r["k"] for b in bounds) for r in rows] and len(bounds) > 5
    assert ordered_bounds(df.limit(0), "k", 50) == []


def brute_mix(rows, block_words, shard_slots=1024, seed=7):
    """taken of each (doc_id, size, source), word by word."""
    import hashlib
    from collections import Counter, defaultdict

    draw = lambda *parts: int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    size = {s: sum(n for _, n, t in rows if t == s) for s in sources}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in full)) / sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and level * weight[s] > 2 * size[s]}
        if not more:
            break
        full |= more
    target = {s: 2.0 * size[s] if s in full else level * weight[s] for s in sources}
    blocks = {s: -(-size[s] // block_words) for s in sources}
    slots = {s: target[s] * blocks[s] / size[s] for s in sources if size[s]}
    want, upto, rounded = {}, 0.0, 0
    for s in sources:
        upto += slots.get(s, 0.0)
        want[s], rounded = min(math.floor(upto + 0.5) - rounded, 2 * blocks[s]), math.floor(upto + 0.5)
    order = [s for s in sources if want[s]]
    n = sum(want.values())
    shards = max(1, -(-n // shard_slots))
    counts = {s: [0] * shards for s in order}
    for slot in range(n):
        u, high = draw(seed, slot) / (1 << 32), 0
        for s in order:
            high += want[s]
            if u < high / n or s == order[-1]:
                counts[s][slot % shards] += 1
                break
    got = {s: sum(counts[s]) for s in order}
    freed = []
    for shard in range(shards):
        for s in order:
            if got[s] > want[s]:
                part = lambda x: want[s] if x >= got[s] else math.floor(x * (want[s] / got[s]))
                before = sum(counts[s][:shard])
                freed += [(shard, s)] * (counts[s][shard] - (part(before + counts[s][shard]) - part(before)))
    lack = [s for s in order for _ in range(max(0, want[s] - got[s]))]
    key = draw(seed, "freed")
    for shard, s in freed:
        counts[s][shard] -= 1
    for r, (shard, _) in enumerate(freed):
        counts[lack[brute_permuted(r, len(lack), key)]][shard] += 1
    times = Counter()
    for s in order:
        no, b = sources.index(s) + 1, blocks[s]
        assert sum(counts[s]) == want[s]
        for i in range(want[s]):
            epoch, k = divmod(i, b)
            times[s, brute_permuted(k, b, draw(seed, no, epoch))] += 1
    out = []
    for s in sources:
        at = 0
        for doc_id, m, _ in sorted(r for r in rows if r[2] == s):
            out.append((doc_id, m, sum(times[s, w // block_words] for w in range(at, at + m))))
            at += m
    return sorted(out)


@pytest.mark.parametrize("shard_slots", [64, 1024])
def test_mix_as_brute_force(spark, small, shard_slots):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r["doc_id"], len((r["text"] or "").encode().split()), r["source"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix_documents(docs, 16, shard_slots).collect())
    assert got == brute_mix(rows, 16, shard_slots)


def test_flat_files_of_any_name(spark, tmp_path):
    for name, ids in (("tokens_000.bin", [5, 6, 0, 7, 0]), ("part-00001", [8, 0]), ("_SUCCESS", [9, 0])):
        (tmp_path / name).write_bytes(np.array(ids, "<u2").tobytes())
    rows = separators.token_counts(spark, str(tmp_path), end_id=0).collect()
    assert sorted((r["file"], r["ordinal"], r["n_tokens"]) for r in rows) == [("part-00001", 0, 2), ("tokens_000.bin", 0, 3), ("tokens_000.bin", 1, 2)]


def test_mixed_shards_hold_the_words_of_blocks(spark):
    sources = ["a", "b", None]
    rows = [(i, " ".join(f"{'' if s is None else s}{i}.{k}" for k in range(3 + 7 * i % 23)), s) for i, s in ((i, sources[i % 3]) for i in range(40))] + [(41, None, "a"), (42, " ", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = mixing.mixed_shards(docs, block_words=8, shard_slots=16).collect()
    streams = {s: [w for _, t, x in sorted(rows, key=lambda r: r[0]) if x == s for w in (t or "").split()] for s in sources}
    assert len(got) > 40 and all(r["words"] == streams[r["source"]][8 * r["block"] : 8 * r["block"] + 8] for r in got)
    assert len({(r["shard"], r["position"]) for r in got}) == len(got) == len({(r["source"], r["block"], r["epoch"]) for r in got})
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs, 8, 16).collect()}
    counts = dict.fromkeys(taken, 0)
    for w in (w for r in got for w in r["words"]):
        counts[int(w.split(".")[0].lstrip("ab"))] += 1
    assert counts == taken


def test_word_store_is_bounded_and_let_go(monkeypatch):
    """Marks behind words and few remembered words change no ids; forget() empties the stores."""
    from tessera.llm import tokens

    monkeypatch.setattr(tokens, "_LOADED", {})
    texts = ["one two, three. four... five., six.\nseven, don't. (eight). nine), ten", "a.b c,d. e.,f one two, three!", "Étude. naïve, straße... one"]
    encode = tokens.encoder(vocabulary(), 5)
    for t in texts * 2:
        assert np.frombuffer(encode(t.encode()), "<u4").tolist() == plain_ids(t)
    store = next(iter(tokens._LOADED.values())).words
    assert 0 < len(store) <= 5 and len(store.old) <= 5
    tokens.forget()
    assert not store and not store.old
