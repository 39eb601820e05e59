"""Similarity, decay and reinforcement, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memweave.schema import CHUNK, CORPUS, DOCUMENT, HALF_LIFE_DAYS, LOG

# Fixed values of the scoring rules.
POOL_FACTOR, POOL_MOST = 5, 200
REINFORCE, REINFORCE_MOST = 0.05, 50
COSINE_SHARE, OBSERVED_SHARE = 0.7, 0.3
#: Distances and scores are ranked as rounded, so that all engines agree on ties.
DIGITS = 6


def vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _sum(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine over the common length; 0 where either norm is 0; null for a null vector."""
    # zip_with fills the shorter one with nulls, which add nothing
    dot = _sum(F.zip_with(a, b, lambda p, q: F.coalesce(p.cast("double") * q.cast("double"), F.lit(0.0))))
    norm = _norm(a) * _norm(b)
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.round(1 - cosine(a, b), DIGITS)


def half_life(node_type: Column) -> Column:
    forever = F.lit(float("inf"))
    return F.when(node_type == LOG, F.lit(HALF_LIFE_DAYS["log"])).when(node_type.isin(CORPUS, DOCUMENT, CHUNK), forever).otherwise(F.lit(HALF_LIFE_DAYS["entity"]))


def age_days(updated_at: Column, created_at: Column, now: str) -> Column:
    """Days since the last change; 0 without a time or in the future."""
    ref = F.coalesce(updated_at, created_at).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", ref, F.lit(now).cast("timestamp_ntz"))
    return F.greatest(F.coalesce(micros / F.lit(86_400_000_000.0), F.lit(0.0)), F.lit(0.0))


def effective_distance(distance: Column, age: Column, life: Column, observed: Column) -> Column:
    """Distance over decay and reinforcement; the distance itself where that divisor is not positive."""
    divisor = F.pow(F.lit(0.5), age / life) * (1 + REINFORCE * F.least(observed, F.lit(REINFORCE_MOST)))
    return F.round(F.when(divisor > 0, distance / divisor).otherwise(distance), DIGITS)


def pool_size(limit: int) -> int:
    return min(max(POOL_FACTOR * limit, 1), POOL_MOST)


def pool_of(limit: Column) -> Column:
    """``pool_size`` of each row's limit."""
    return F.least(F.greatest(POOL_FACTOR * limit, F.lit(1)), F.lit(POOL_MOST)).cast("int")


def frontier_score(similarity: Column, observed: Column, most_observed: Column) -> Column:
    share = F.when(most_observed > 0, observed / most_observed).otherwise(F.lit(0.0))
    return F.round(COSINE_SHARE * F.coalesce(similarity, F.lit(0.0)) + OBSERVED_SHARE * share, DIGITS)


def iso(at: Column) -> Column:
    """A time as an ISO string in UTC, for a session in UTC; fractions only where there are any."""
    fraction = F.when(F.pmod(F.unix_micros(at), F.lit(1_000_000)) != 0, F.date_format(at, ".SSSSSS")).otherwise("")
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("+00:00"))


def now_iso() -> Column:
    return iso(F.current_timestamp())
