"""The whole evaluation: reference against output, as one table of scores.

A component that the data do not allow is reported as unavailable with its reason and doesn't stop the others; any
other error is one.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import DataError
from ..functions import scoring
from ..functions import text as X
from ..sources.shared import kept
from . import components as PC
from . import correlation as C
from . import distribution as D
from . import joins as J
from . import privacy as V
from . import profile as P
from .encoding import semantic_similarity


@dataclass
class Score:
    component: str
    raw: float | None
    score: float | None
    grade: str
    notes: str = ""


def _graded(component: str, frame: DataFrame, raw: str, curve) -> Score:
    row = frame.select(F.round(raw, 4).alias("raw"), scoring.final_score(curve(F.col(raw))).alias("score")).select("raw", "score", scoring.grade(F.col("score")).alias("grade")).first()
    return Score(component, row["raw"], row["score"], row["grade"])


def evaluate(
    reference: DataFrame, output: DataFrame, key: str, most_rows: int | None = None, most_columns: int | None = None, test: DataFrame | None = None, vector: str | None = None, personal: tuple[str, ...] = (), attacked: int = V.ATTACKED,
) -> list[Score]:
    """Scores of quality (distribution, correlation, structure, text) and of privacy, and both overall scores.

    All rows and shared columns are scored.  Sampling is an option: with most_rows, that many rows a side
    by hash of the key, and with most_columns the first of them by name.  With held-out test rows membership and, for a
    vector column of texts, semantic likeness are scored as well; replay counts the personal columns' values, of all rows.
    The attribute attack goes for ``attacked`` rows, and its score says how many there were.
    """
    columns = sorted(c for c in J.shared_columns(reference, output) if c not in (key, vector))[:most_columns]
    sides = [P.clean(d.select(key, *columns)) for d in (reference, output)]
    if most_rows is not None:
        sides = [s.orderBy(F.xxhash64(F.lit(424242), F.col(key)), key).limit(most_rows) for s in sides]
    columns = [c for c in columns if all(c in s.columns for s in sides)]
    # some thirty passes follow, and each reads a few columns of these
    sides = [kept(s.select(*[F.col(c).cast("string" if t == "void" else t).alias(c) for c, t in s.dtypes]), "side") for s in sides]
    types = {r["column"]: r["field_type"] for r in P.profile(sides[0].drop(key)).collect()}
    numeric = [c for c in columns if types[c] == "numeric"]
    nominal = [c for c in columns if types[c] in ("categorical", "binary")]
    texts = [c for c in columns if types[c] == "text"]
    tabular = [c for c in columns if c not in texts]
    both = sides[0].withColumn("side", F.lit(0)).unionByName(sides[1].withColumn("side", F.lit(1)), allowMissingColumns=True)
    scores: dict[str, Score] = {}

    def attempt(name: str, make) -> None:
        try:
            scores[name] = make()
        except DataError as e:  # reported, and the other components go on
            scores[name] = Score(name, None, None, "Unavailable", str(e))

    def needs(fine: bool, what: str) -> None:
        if not fine:
            raise DataError(what)

    def distribution() -> Score:
        cells = [D.histograms(both, numeric, "side").withColumn("value", F.col("bucket").cast("string")).drop("bucket")] if numeric else []
        if nominal:
            cells.append(D.categorical_distribution(both, nominal, "side").select("column", "value", "side", "n"))
        needs(bool(cells), "no numeric or categorical column")
        every = cells[0]
        for c in cells[1:]:
            every = every.unionByName(c)
        return _graded("distribution", D.mean_divergence(D.js_distance(every, ["column"], "value")), "divergence", scoring.tabular_js_score)

    def correlation() -> Score:
        needs(len(numeric) + len(nominal) > 1, "fewer than two columns")
        return _graded("correlation", C.correlation_error(*[C.mixed_correlation(s, nominal, numeric) for s in sides]), "mae", scoring.correlation_score)

    def structure() -> Score:
        needs(len(numeric) > 1, "fewer than two numeric columns")
        filled = C.median_filled(both.select("side", *[F.col(c).cast("double").alias(c) for c in numeric]), numeric)
        points = PC.projected(filled, PC.principal_components(filled.filter("side = 0"), numeric), ["side"])
        cells = D.histograms(points, ["pc1", "pc2"], "side")
        return _graded("structure", D.mean_divergence(D.js_distance(cells, ["column"], "bucket")), "divergence", scoring.structure_score)

    def text_structure() -> Score:
        needs(bool(texts), "no text column")
        return _graded("text_structure", D.mean_divergence(text_structure_distances(both, texts, "side")), "divergence", scoring.text_js_score)

    def text_semantic() -> Score:
        needs(vector is not None and test is not None, "no vectors or no test rows")
        row = semantic_similarity(reference, output, test, key, vector).select(scoring.final_score(F.col("score")).alias("s"), "score").first()
        return Score("text_semantic", row["score"], row["s"], _grade(reference, row["s"], scoring.QUALITY_GRADES))

    def membership() -> Score:
        needs(test is not None and bool(tabular or vector), "no test rows")
        row = V.membership_inference(reference, output, test, key, numeric + nominal, vector)[1].first()
        return Score("membership", row["mean"], row["score"], _grade(reference, row["score"], scoring.PRIVACY_GRADES))

    def attribute() -> Score:
        needs(len(numeric) + len(nominal) > 1, "fewer than two columns")
        known = min(3, len(numeric) + len(nominal) - 1)
        row = V.attribute_inference(reference, output, key, numeric + nominal, known, attacked=attacked)[1].first()
        return Score("attribute", row["accuracy"], row["score"], _grade(reference, row["score"], scoring.PRIVACY_GRADES), f"{row['attacked']} rows under attack")

    def replay() -> Score:
        counted = [c for c in personal if types.get(c) != "text"]  # whole texts are no values that an output could replay
        needs(bool(counted), "no personal columns but texts")
        row = V.replay(reference, output, counted).agg(F.sum("replayed_values"), F.max("percent")).first()
        return Score("replay", float(row[0] or 0), None, "", f"{row[1]} per cent of a column's values at most")

    for make in (distribution, correlation, structure, text_structure, text_semantic, membership, attribute, replay):
        attempt(make.__name__, make)
    value = lambda name: F.lit(scores[name].score).cast("double")
    rows = scoring.quality_score(value("correlation"), value("structure"), value("distribution"))
    prose = scoring.text_quality_score(value("text_semantic"), value("text_structure"))
    n_text = len(texts) + (vector is not None)
    weighted = F.when(prose.isNull(), rows).when(rows.isNull(), prose).otherwise((rows * len(tabular) + prose * n_text) / F.lit(len(tabular) + n_text))
    for name, raw, grades in (("quality", weighted, scoring.QUALITY_GRADES), ("privacy", scoring.mean_of_nonzero(value("membership"), value("attribute")), scoring.PRIVACY_GRADES)):
        row = reference.sparkSession.range(1).select(raw.alias("raw"), scoring.final_score(raw).alias("score")).first()
        scores[name] = Score(name, row["raw"], row["score"], _grade(reference, row["score"], grades))
    return list(scores.values())


def _grade(df: DataFrame, score: float | None, names: tuple[str, ...]) -> str:
    return "Unavailable" if score is None else df.sparkSession.range(1).select(scoring.grade(F.lit(float(score)), names)).first()[0]


def text_structure_distances(both: DataFrame, texts: list[str], side: str) -> DataFrame:
    """column and distance of three numbers of each text column: sentences, words a sentence, characters a word."""
    made = both.select(side, *[f.alias(f"{c}.{n}") for c in texts for n, f in (("sentences", X.sentence_count(F.col(c)).cast("double")), ("words", X.words_per_sentence(F.col(c))), ("characters", X.characters_per_word(F.col(c))))])
    parts = [D.histogram(made.select(side, F.col(f"`{c}`").alias("x")), "x", side).withColumn("column", F.lit(c)) for c in made.columns if c != side]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return D.js_distance(every, ["column"], "bucket")


def as_json(scores: list[Score]) -> str:
    """The scores by component name."""
    return json.dumps({s.component: {"raw": s.raw, "score": s.score, "grade": s.grade, "notes": s.notes} for s in scores}, sort_keys=True)
