"""Answers of models: fences stripped, cut JSON closed, fields kept to those asked; batches of questions packed by size."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rostrum.functions.text import strip

#: Where a scan of JSON stands. Within a string, and behind a backslash in one:
PLAIN, STRING, ESCAPE = 0, 1, 2
#: What is due outside: a key, the colon behind one, a value, the comma or bracket behind one; or a word or number is being read.
KEY, COLON, VALUE, AFTER, WORD = "k", "c", "v", "e", "w"


def unfenced(answer: Column) -> Column:
    """The inside of the fence that a text begins with, without the language's name; else the text, without white space at its ends."""
    t = strip(F.coalesce(answer, F.lit("")))
    return strip(F.when(t.startswith("```"), F.regexp_replace(F.get(F.split(t, "```"), F.lit(1)), r"^(?i:json)?", "")).otherwise(t))


def _scan(text: Column) -> Column:
    """How far a JSON text goes: the brackets still open (their closers, innermost first), mode, what is due, and the place where the value ends, 0 if it does not."""
    start = F.struct(F.lit("").alias("open"), F.lit(PLAIN).alias("mode"), F.lit(VALUE).alias("due"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(a: Column, c: Column) -> Column:
        plain, at = a.mode == PLAIN, a.at + 1
        closes = plain & c.isin("}", "]")
        stack = F.when(plain & (c == "{"), F.concat(F.lit("}"), a.open)).when(plain & (c == "["), F.concat(F.lit("]"), a.open)).when(closes, F.substr(a.open, F.lit(2))).otherwise(a.open)
        mode = F.when(a.mode == ESCAPE, STRING).when((a.mode == STRING) & (c == "\\"), ESCAPE).when(c == '"', F.when(plain, STRING).otherwise(PLAIN)).otherwise(a.mode)
        within = F.when(~plain & (a.mode == STRING) & (c == '"'), F.when(a.due == KEY, COLON).otherwise(AFTER)).otherwise(a.due)
        due = (
            F.when(~plain, within).when(c == "{", KEY).when(c == "[", VALUE).when(closes, AFTER).when(c == ":", VALUE).when(c == ",", F.when(a.open.startswith("}"), KEY).otherwise(VALUE))
            .when((c == '"') | c.rlike(r"^\s$"), F.when(a.due == WORD, AFTER).otherwise(a.due)).otherwise(WORD)
        )
        end = F.when(closes & (stack == ""), at).otherwise(0)
        return F.when(a.end > 0, a).otherwise(F.struct(stack.alias("open"), mode.alias("mode"), due.alias("due"), at.alias("at"), end.alias("end")))

    return F.aggregate(F.split(text, ""), start, step)


def repaired(answer: Column) -> Column:
    """The JSON value in an answer, closed where it is cut off; null where there is none that can be read.

    Text before the first brace or bracket and behind the value's end is left out. A scan with a stack says what is open: a cut string ends
    where it is cut, a key without a value gets null, a begun word or number is completed or shortened, a comma at the end goes,
    and open brackets are closed, innermost first. One pass over the text."""
    text = F.regexp_extract(unfenced(answer), r"(?s)([{\[].*)", 1)
    s = _scan(text)
    cut = F.when(s.mode == ESCAPE, F.substr(text, F.lit(1), F.length(text) - 1)).otherwise(text)
    closed = F.when(s.mode > PLAIN, F.concat(F.regexp_replace(cut, r"(?<!\\)((?:\\\\)*)\\u[0-9A-Fa-f]{0,3}$", "$1"), F.lit('"'))).otherwise(cut)
    due = F.when(s.mode > PLAIN, F.when(s.due == KEY, COLON).otherwise(AFTER)).otherwise(s.due)
    word = F.regexp_extract(closed, r"([A-Za-z]+)$", 1)
    number = F.regexp_replace(F.regexp_replace(F.regexp_replace(closed, r"(?<=[0-9.])[eE][+-]?$", ""), r"\.$", ""), r"-$", "null")
    whole = F.when(word == "", number)
    for w in ("true", "false", "null"):
        whole = whole.when(F.lit(w).startswith(word), F.concat(closed, F.substr(F.lit(w), F.length(word) + 1)))
    bare = F.regexp_replace(closed, r"[\s,]+$", "")
    tail = F.when(due == WORD, whole.otherwise(number)).when(due == COLON, F.concat(closed, F.lit(":null")))
    tail = tail.when((due == VALUE) & closed.rlike(r":\s*$"), F.concat(closed, F.lit("null"))).when(due.isin(KEY, VALUE), bare).otherwise(closed)
    out = F.when(s.end > 0, F.substr(text, F.lit(1), s.end)).otherwise(F.concat(tail, s.open))
    return F.when(F.try_parse_json(out).isNotNull(), out)


def requirement_answer(answer: Column) -> Column:
    """The parsed requirements in a model's answer as a VARIANT, repaired if need be; null for none."""
    return F.try_parse_json(repaired(answer))


RANKED = "array<struct<candidate_id: string, re_rank_score: double, meets_requirements: boolean, requirements_met: array<string>, requirements_missing: array<string>>>"


def rerank_answers(answers: DataFrame, answer: str, asked: list[str] | None = None) -> DataFrame:
    """``answers`` without that column, a row for each candidate that one names: candidate_id, re_rank_score, meets_requirements, requirements_met and
    requirements_missing, the last two without what is not among ``asked`` (where given). Candidates without an id are left out, and answers that cannot be read."""
    got = F.from_json(F.get_json_object(repaired(F.col(answer)), "$.ranked_candidates"), RANKED)
    rest = [c for c in answers.columns if c != answer]
    rows = answers.select(*rest, F.inline(F.coalesce(got, F.array().cast(RANKED)))).where("candidate_id is not null")
    wanted = F.array(*map(F.lit, asked or [])).cast("array<string>")
    only = lambda c: F.coalesce(F.array_intersect(c, wanted) if asked else F.col(c), F.array().cast("array<string>"))
    return rows.withColumns({c: only(c) for c in ("requirements_met", "requirements_missing")})


def packed(rows: DataFrame, size: Column, most: int, rank: str = "rank", rows_each: int = 30, out: str = "batch") -> DataFrame:
    """Ranked rows in batches of neighbours, at most ``rows_each`` rows each, and begun anew wherever another row would go beyond ``most`` in size by the sizes before it.

    Batches are structs of block and part. A block is ``rows_each`` ranks, cut into parts by the running sum of sizes, so no
    group is larger than that; a single row beyond ``most`` stands in a batch of its own size."""
    block = F.floor((F.col(rank) - 1) / rows_each).cast("int")
    before = F.coalesce(F.sum(size).over(Window.partitionBy("_block").orderBy(rank).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parted = rows.withColumn("_block", block).withColumn("_part", F.floor(before / most).cast("int"))
    return parted.withColumn(out, F.struct(F.col("_block").alias("block"), F.col("_part").alias("part"))).drop("_block", "_part")
