"""Queries whose rows SQL cannot give, held against plain Python over the whole small tables."""

import collections
import zlib

import numpy as np

import corpus_pipeline as P
from tessera.llm import language, separators, toxicity
from tessera.llm.common import written
from tessera.llm.labelled import held_out
from tests.llm.test_packing_and_files import plain_ids
from tests.llm.test_search_and_texts import brute_components


def test_token_counts_of_every_document(spark, small):
    want = {r["doc_id"]: len(plain_ids(r["text"])) + 1 for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = separators.op3_token_counts(spark, small).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == want and len(rows) == len(want) and all(r["closed"] for r in rows)
    at = collections.defaultdict(list)
    for r in rows:
        at[r["file_no"]].append((r["start"], r["n_tokens"]))
    for spans in at.values():  # documents of a file stand one behind the other
        spans.sort()
        assert [s for s, _ in spans] == np.cumsum([0] + [n for _, n in spans])[:-1].tolist()


def test_pipeline_stage_by_stage(spark, small):
    """Each stage against its own input: what it keeps, what it changes, and no row beside."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = lambda df: {r["doc_id"]: r for r in df.collect()}
    given = rows(docs)
    made = {}
    for name, stage in P.STAGES:
        docs = made[name] = written(stage(spark, docs, small), f"test-{name}")
    assert [n for n, _ in P.STAGES] == ["toxicity", "language_id", "ngram_join", "mixing", "packing"]

    source = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fitted(source, spark.read.parquet(f"{small}/labels.parquet"), held_out(3, 1))
    scores = {r["doc_id"]: r["s"] for r in toxicity.scored(source, model, score="s").select("doc_id", "s").collect()}
    clean = rows(made["toxicity"])
    assert set(clean) == {i for i, s in scores.items() if s < toxicity.THRESHOLD} and all(clean[i] == given[i] for i in clean)

    told = rows(made["language_id"])
    sure = {r["row"]["doc_id"]: r for r in language.identified_rows(made["toxicity"]).collect()}
    assert set(told) == {i for i, r in sure.items() if r["has_letters"] and (r["posterior"] is None or r["posterior"] >= language.LEAST_POSTERIOR)}
    assert all(told[i]["lang"] == sure[i]["identified"] and told[i]["text"] == given[i]["text"] for i in told)

    groups = collections.defaultdict(list)
    for i, (_, component) in brute_components([(i, r["text"]) for i, r in told.items()]).items():
        groups[component].append(i)
    single = rows(made["ngram_join"])
    assert set(single) == {min(g) for g in groups.values()} and all(single[i] == told[i] for i in single)

    mixed = made["mixing"].collect()
    words = lambda t: (t or "").encode().split()
    for r in mixed:
        n, size = len(words(r["text"])), len(words(single[r["doc_id"]]["text"]))
        assert r["doc_id"] in single and n <= 2 * size and set(words(r["text"])) <= set(words(single[r["doc_id"]]["text"]))

    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in made["packing"].collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    texts = {r["doc_id"]: r["text"] for r in mixed}
    assert set(pieces) == set(texts)
    for i, found in pieces.items():
        ids = np.array([*plain_ids(texts[i]), 0], "<u4")
        found.sort(key=lambda r: r["piece"])
        assert [r["start"] for r in found] == list(range(0, len(ids), 2048))
        for r in found:
            part = ids[r["start"] : r["start"] + 2048]
            assert (r["length"], r["ids_crc32"]) == (len(part), zlib.crc32(part.tobytes()))
    for places in sequences.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0] + [n for _, n in places])[:-1].tolist() and sum(n for _, n in places) <= 2048
