"""Blinded A/B ballots and their tallies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_ws
from .sampling import DEFAULT_SEED, sample_k

# The two comparisons, each (plain system, prompt system), in file order.
COMPARISONS: dict[str, tuple[str, str]] = {"fs": ("fs", "fs_prompt"), "mtl": ("mtl", "mtl_prompt")}
# The ballot file header.
BALLOT_HEADER = ["Random ID", "Context", "Response A", "Response B", "Your Answer? (Enter A, B or Neutral)"]
BALLOT_COLUMNS = ["random_id", "context", "response_a", "response_b", "answer"]


def _case(col: str, mapping: Mapping[str, str]) -> F.Column:
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col(col) == k, F.lit(v)) if expr is None else expr.when(F.col(col) == k, F.lit(v)))
    return expr


def build_ballots(pairs: DataFrame, predictions: DataFrame, k: int = 100, seed: int = DEFAULT_SEED,
                  languages: DataFrame | None = None, context: str = "context",
                  comparisons: Mapping[str, tuple[str, str]] = COMPARISONS,
                  strict: bool = True, sampler: str = "hash") -> DataFrame:
    """Draw k test rows per language for each comparison and place the two
    systems' outputs side by side, blinded by row parity.

    Odd position: plain system in A, prompt system in B; even: the other way.
    ``row_no`` is the 1-based line of the ballot file (comparison blocks in order,
    positions ascending inside a block). With ``strict``, a missing prediction
    for a drawn row fails the job, as a short prediction file does.
    Languages with fewer than k rows get no ballot.
    ``sampler="mt19937"`` draws the blocks as the reference does: one seeded
    Mersenne Twister stream per language, one ``sample`` call per comparison.
    """
    names = list(comparisons)
    if languages is not None:
        pairs = pairs.join(languages.select("lang").distinct(), "lang", "left_semi")
    if sampler == "mt19937":
        from .sampling import draw_positions_mt, group_counts, pick_rows

        draws = draw_positions_mt(pairs.sparkSession, group_counts(pairs, ["lang"]), k, seed, draws=len(names))
        draws = draws.withColumn("draw", _case("draw", {str(i): c for i, c in enumerate(names)}))
        drawn = pick_rows(pairs.select("lang", "pos", context), draws)
    elif sampler == "hash":
        drawn = sample_k(pairs.select("lang", "pos", context), k, seed, ["lang"], "pos", draws=names)
    else:
        raise ValueError(f"unknown sampler {sampler!r}; choose 'hash' or 'mt19937'")
    keys = drawn.select("lang", "pos", F.col("draw").alias("comparison"), "shot_ordinal",
                        F.col(context).alias("context"))
    plain = _case("comparison", {c: s[0] for c, s in comparisons.items()})
    prompt = _case("comparison", {c: s[1] for c, s in comparisons.items()})
    systems = sorted({s for pair in comparisons.values() for s in pair})
    side = (predictions.filter(F.col("system").isin(*systems))
            .join(keys.select("lang", "pos", "comparison"), ["lang", "pos"])
            .groupBy("lang", "pos", "comparison")
            .agg(F.max(F.when(F.col("system") == plain, F.col("prediction"))).alias("plain"),
                 F.max(F.when(F.col("system") == prompt, F.col("prediction"))).alias("prompt")))
    joined = keys.join(side, ["lang", "pos", "comparison"], "left")
    if strict:
        missing = F.lit("a prediction is missing for a drawn row")
        for c in ("plain", "prompt"):
            joined = joined.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(missing)).otherwise(F.col(c)))
    odd = F.col("pos") % 2 == 1
    block = _case("comparison", {c: str(i) for i, c in enumerate(names)}).cast("long")
    return joined.select(
        "lang", "comparison",
        F.col("pos").alias("random_id"), "context",
        F.when(odd, F.col("plain")).otherwise(F.col("prompt")).alias("response_a"),
        F.when(odd, F.col("prompt")).otherwise(F.col("plain")).alias("response_b"),
        F.lit("").alias("answer"),
        (block * F.lit(k) + F.col("shot_ordinal")).alias("row_no"),
    )


def unblind(answer: F.Column, random_id: F.Column) -> F.Column:
    """'plain', 'prompt' or 'neutral'. Only an exact A or B (after strip) counts."""
    a = strip_ws(F.coalesce(answer, F.lit("")))
    odd = random_id % 2 == 1
    return (F.when(a == "A", F.when(odd, "plain").otherwise("prompt"))
            .when(a == "B", F.when(odd, "prompt").otherwise("plain"))
            .otherwise("neutral"))


def tally(ballots: DataFrame, by: Sequence[str] = ("lang", "comparison")) -> DataFrame:
    """Plain / neutral / prompt counts and the total per group."""
    vote = unblind(F.col("answer"), F.col("random_id").cast("long"))
    return ballots.select(*by, vote.alias("__v")).groupBy(*by).agg(
        F.count_if(F.col("__v") == "plain").alias("plain"),
        F.count_if(F.col("__v") == "neutral").alias("neutral"),
        F.count_if(F.col("__v") == "prompt").alias("prompt"),
        F.count(F.lit(1)).alias("total"))


def with_positional_comparison(ballots: DataFrame, block_size: int = 100,
                               names: Sequence[str] = tuple(COMPARISONS)) -> DataFrame:
    """Recover the comparison from the file line: lines 1..100 are the first
    comparison, the rest the second."""
    return ballots.withColumn(
        "comparison", F.when(F.col("row_no") <= block_size, names[0]).otherwise(names[1]))


def tally_by_family(ballots: DataFrame, languages: DataFrame) -> DataFrame:
    """Tallies per language family."""
    fam = ballots.join(languages.select("lang", "family"), "lang")
    return tally(fam, ["family", "comparison"])


def fill_answers(ballots: DataFrame) -> DataFrame:
    """Deterministic stand-in answers: first hex digit of md5(lang|comparison|pos)
    0-5 -> 'A', 6-a -> ' B ', b-d -> 'Neutral', e-f -> ''."""
    d = F.substring(F.md5(F.concat_ws("|", "lang", "comparison", F.col("random_id").cast("string"))), 1, 1)
    ans = (F.when(d.isin(*"012345"), "A").when(d.isin(*"6789a"), " B ")
           .when(d.isin(*"bcd"), "Neutral").otherwise(""))
    return ballots.withColumn("answer", ans)
