"""Column expressions: cleaning, slot time, row-wise statistics, labels and combinations.

All of them are built-in functions, so they stay within code generation. Missing values stay
missing unless a function says otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Slot of each hour of the day from 0 to 23; a day begins at 6. Fixed value.
SLOT_OF_HOUR = (5, 6, 6, 6, 6, 6, 1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4, 5, 5)
#: Five-minute records in slots 1 to 6, and hours after midnight at which they begin. Fixed values.
EXPECTED_RECORDS = (48, 48, 48, 48, 36, 60)
START_HOUR = (6, 10, 14, 18, 22, 25)
SLOTS = 6
ORIGIN = "2000-01-01"
#: Missing-value code of the alumina signal. Fixed value.
SENTINEL = 9999


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# cleaning


def decimal_comma(c: Column | str) -> Column:
    """Text with a decimal comma or point as double; anything else is null."""
    text = F.trim(col(c).cast("string"))
    plain = F.regexp_replace(text, ",", ".")
    return F.when(plain.rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))


def number(c: Column | str) -> Column:
    """Anything as double; what isn't a number, NaN included, is null."""
    return F.nanvl(col(c).cast("string").try_cast("double"), F.lit(None).cast("double"))


def day_first_date(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c).cast("string"), F.lit("dd/MM/yyyy")).cast("date")


def timestamp(c: Column | str) -> Column:
    return F.try_to_timestamp(col(c).cast("string")).cast("timestamp_ntz")


def without_sentinel(c: Column | str, sentinel: float = SENTINEL) -> Column:
    return F.nullif(col(c), F.lit(sentinel))


def finite(c: Column | str) -> Column:
    """Null for an infinity or NaN."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def plain_id(c: Column | str) -> Column:
    """An id as trimmed text without a trailing .0"""
    return F.regexp_replace(F.trim(col(c).cast("string")), r"\.0$", "")


# slot time


def _lookup(values: Sequence, at: Column) -> Column:
    """values[at]; null if at is."""
    return F.get(F.array(*map(F.lit, values)), at)


def slot(ts: Column | str) -> Column:
    """Slot 1 to 6 of a timestamp within its operating day; slots have unequal lengths."""
    return _lookup(SLOT_OF_HOUR, F.hour(col(ts)))


def operating_date(ts: Column | str) -> Column:
    """The day that began at the last 06:00."""
    ts = col(ts)
    return F.when(F.hour(ts) < 6, F.date_sub(F.to_date(ts), 1)).otherwise(F.to_date(ts))


def absolute_order(day: Column | str, slot_: Column | str) -> Column:
    """Ordinal of a slot, six a day, from a fixed origin."""
    return (F.datediff(col(day), F.lit(ORIGIN).cast("date")) * SLOTS + col(slot_)).cast("long")


def slot_of_order(order: Column | str) -> Column:
    return (F.pmod(col(order) - 1, F.lit(SLOTS)) + 1).cast("int")


def expected_records(slot_: Column | str) -> Column:
    return _lookup(EXPECTED_RECORDS, col(slot_) - 1)


def slot_start(day: Column | str, slot_: Column | str) -> Column:
    """Timestamp at which a slot of an operating day begins; slot 6 begins at 01:00 of the next day."""
    return col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=_lookup(START_HOUR, col(slot_) - 1))


def month(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def expected_month_rows(day: Column | str, cells: int = 384, per_day: int = 288) -> Column:
    """Five-minute records that all cells would have in the month of day."""
    return (F.dayofmonth(F.last_day(col(day))) * cells * per_day).cast("long")


# arithmetic


def positive_part(c: Column | str) -> Column:
    c = col(c)
    return F.when(c < 0, 0.0).otherwise(c)


def negative_part(c: Column | str) -> Column:
    c = col(c)
    return F.when(c > 0, 0.0).otherwise(c)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0 or either is missing."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def improvement(base: Column | str, model: Column | str) -> Column:
    """By how many percent model is below base."""
    return ratio((col(base) - col(model)) * 100, base)


def flag(condition: Column) -> Column:
    """1 if true, else 0, also for missing."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def nullable_flag(condition: Column) -> Column:
    return condition.cast("int")


def one_hot(c: Column | str, codes: Sequence, prefix: str, other: str = "other") -> list[Column]:
    """A flag column per code, and one for all other values that aren't missing."""
    c = col(c)
    return [*[flag(c == k).alias(f"{prefix}_{k}") for k in codes], flag(c.isNotNull() & ~c.isin(*codes)).alias(f"{prefix}_{other}")]


# across columns of a row


def row_count(*columns: Column | str) -> Column:
    return reduce(add, [col(c).isNotNull().cast("int") for c in columns])


def row_mean(*columns: Column | str) -> Column:
    """Mean of the values that are there."""
    return ratio(reduce(add, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns]), row_count(*columns))


def row_std(*columns: Column | str) -> Column:
    """Sample standard deviation of the values that are there; null for fewer than two."""
    mean, n = row_mean(*columns), row_count(*columns)
    squares = reduce(add, [F.coalesce(F.pow(col(c) - mean, 2), F.lit(0.0)) for c in columns])
    return F.when(n > 1, F.sqrt(ratio(squares, n - 1)))


def row_max(*columns: Column | str) -> Column:
    return F.greatest(*map(col, columns))


def row_min(*columns: Column | str) -> Column:
    return F.least(*map(col, columns))


def slope(newest: Column | str, oldest: Column | str, steps: int = 2) -> Column:
    return (col(newest) - col(oldest)) / steps


# bins and labels


def right_closed(c: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the bin (edge, next edge] that holds c, below the first and above the last included; null if c is."""
    c = col(c)
    out = F.when(c.isNull(), None)
    for edge, label in zip(edges, labels, strict=False):
        out = out.when(c <= edge, label)
    return out.otherwise(labels[len(edges)])


def life_phase(age: Column | str) -> Column:
    return right_closed(age, (100, 1200), ("start", "stable", "end"))


def error_range(c: Column | str) -> Column:
    return right_closed(c, (955, 965, 975, 985), ("<=955", "955-965", "965-975", "975-985", ">985"))


def direction(delta: Column | str, step: float = 5.0) -> Column:
    """0 falling by step or more, 1 about the same, 2 rising by step or more."""
    d = col(delta)
    return F.when(d <= -step, 0).when(d >= step, 2).when(d.isNotNull(), 1)


def chronological_split(day: Column | str, validation_from, test_from) -> Column:
    d = col(day)
    return F.when(d >= F.lit(test_from), "test").when(d >= F.lit(validation_from), "validation").otherwise("train")


def argmax(*probabilities: Column | str) -> Column:
    """Place of the largest, from 0; the first of equals."""
    a = F.array(*map(col, probabilities))
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


# predictions and weights


def baseline_last(last: Column | str) -> Column:
    return col(last)


def baseline_mean_of_two(last: Column | str, before: Column | str) -> Column:
    """Mean of what is there of the last two."""
    return row_mean(last, before)


def baseline_extrapolated(last: Column | str, before: Column | str) -> Column:
    """The last change goes on; the last value where there is no change to go by."""
    return F.coalesce(2 * col(last) - col(before), col(last))


def combined(base, correction, hot_probability, prevalence, alpha: float = 1.0, beta: float = 0.0, constant: float = 0.0) -> Column:
    """base + alpha * correction + beta * (p - prevalence) + constant"""
    return col(base) + alpha * col(correction) + beta * (col(hot_probability) - col(prevalence)) + constant


def balanced(base, correction, hot_probability, prevalence, p_cool, p_heat, beta=2.0, constant=-0.5, push_cool=0.25, push_heat=0.25) -> Column:
    """combined() with a push down by the chance of cooling and a push up by that of heating."""
    return combined(base, correction, hot_probability, prevalence, 1.0, beta, constant) - push_cool * col(p_cool) + push_heat * col(p_heat)


def blended(base, correction, weighted_correction, hot_probability, prevalence, p_cool, p_heat, gamma=0.0, beta=1.0, constant=0.0, push_cool=0.0, push_heat=0.0) -> Column:
    """balanced() over a blend of the plain and the weighted regressor's correction."""
    mixed = (1 - gamma) * col(correction) + gamma * col(weighted_correction)
    return balanced(base, mixed, hot_probability, prevalence, p_cool, p_heat, beta, constant, push_cool, push_heat)


#: Strategies of training weights: conditions in the order in which they are tried, with their weights.
WEIGHTS = {"none": (), "heating": (("heating", 4.0),), "hot": (("hot", 4.0),), "both": (("hot", 4.0), ("heating", 3.0))}


def sample_weight(delta: Column | str, target: Column | str, strategy: str = "both", hot: float = 970.0, heating: float = 5.0) -> Column:
    """Weight of a training row; a hot target decides before a heating one."""
    tests = {"hot": col(target) >= hot, "heating": col(delta) > heating}
    out = F.lit(1.0)
    for name, weight in reversed(WEIGHTS[strategy]):
        out = F.when(tests[name], weight).otherwise(out)
    return out


def date_of_order(order: Column | str) -> Column:
    """The operating day of an absolute ordinal."""
    return F.date_add(F.lit(ORIGIN).cast("date"), F.floor((col(order) - 1) / SLOTS).cast("int"))
