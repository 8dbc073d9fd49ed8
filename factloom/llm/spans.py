"""Pattern matches with code-point positions, and redaction, as DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Code points kept of the text before and after a match.
CONTEXT = 40
# Matches folded at once.
BLOCK = 256
FOUND = "array<struct<kind:int,start:int,end:int,value:string,before:string,after:string>>"


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(array: Column) -> Column:
    """Numbers of the blocks of BLOCK elements; one for an empty array."""
    return F.sequence(F.lit(0), F.greatest(F.floor((F.size(array) - 1) / BLOCK), F.lit(0)).cast("int"))


def add_matches(df: DataFrame, name: str, text: str, kind: int, pattern: str, keep=None) -> DataFrame:
    """Column name: the leftmost non-overlapping matches of a pattern in a text column, as an array of FOUND structs.

    Splitting at the pattern gives the text between the matches, and the lengths of both give the positions. keep: a condition on a
    match's value; failing matches are dropped after matching. Matches are folded in blocks, so that the work grows with their number and not with
    its square: a fold copies what it has found so far at every step.
    """
    between, whole = f"{name}_between", f"{name}_whole"
    df = df.withColumn(between, F.split(text, pattern, -1)).withColumn(whole, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    parts = F.arrays_zip(F.col(between).alias("a"), F.col(whole).alias("b"), F.slice(between, 2, F.size(between)).alias("c"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["a"])
        end = start + F.length(part["b"])
        own = F.struct(F.lit(kind).alias("kind"), start.cast("int").alias("start"), end.cast("int").alias("end"), part["b"].alias("value"),
                       F.right(part["a"], F.lit(CONTEXT)).alias("before"), F.left(F.coalesce(part["c"], F.lit("")), F.lit(CONTEXT)).alias("after"))
        wanted = part["b"].isNotNull() if keep is None else part["b"].isNotNull() & keep(part["b"])
        return F.struct(F.coalesce(end, start).alias("at"), F.when(wanted, F.concat(state["found"], F.array(own))).otherwise(state["found"]).alias("found"))

    none = F.array().cast(FOUND)

    def block(all_parts: Column):
        def run(state: Column, i: Column) -> Column:
            own = F.aggregate(F.slice(all_parts, i * BLOCK + 1, BLOCK), F.struct(state["at"].alias("at"), none.alias("found")), step)
            return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(state["found"], F.array(o["found"])).alias("found")))

        return run

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{FOUND}>").alias("found"))
    return df.withColumn(name, _let(parts, lambda p: F.aggregate(_blocks(p), start, block(p), lambda s: F.flatten(s["found"])))).drop(between, whole)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a short string of digits passes the Luhn check."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(places, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:end of sorted spans, with commas between."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(F.array(*[F.lit(n) for n in names]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def redacted(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span, in order of start, replaced by a mark; overlapping ones become one mark.

    Spans are taken in blocks, each with the piece of the text up to the next block, so that neither the text nor what is written is gone through at every span.
    """
    def block(all_spans: Column):
        def run(state: Column, i: Column) -> Column:
            following = F.coalesce(F.get(all_spans, (i + 1) * BLOCK)["start"], F.length(text))
            end = F.greatest(following, state["at"])
            return _let(F.struct(state["at"].alias("base"), end.alias("end"), text.substr(state["at"] + 1, end - state["at"]).alias("piece")), lambda v: _let(
                F.aggregate(F.slice(all_spans, i * BLOCK + 1, BLOCK), F.struct(v["base"].alias("at"), F.array().cast("array<string>").alias("out")), lambda s, span: F.struct(
                    F.greatest(s["at"], span["end"]).alias("at"),
                    F.when(span["start"] >= s["at"], F.concat(s["out"], F.array(v["piece"].substr(s["at"] - v["base"] + 1, span["start"] - s["at"]), F.lit(mark)))).otherwise(s["out"]).alias("out"))),
                lambda o: F.struct(F.greatest(o["at"], v["end"]).alias("at"), F.concat(state["out"], F.array(F.concat(
                    F.array_join(o["out"], ""), F.when(v["end"] > o["at"], v["piece"].substr(o["at"] - v["base"] + 1, v["end"] - o["at"])).otherwise(F.lit(""))))).alias("out"))))

        return run

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.when(F.coalesce(F.size(spans), F.lit(0)) <= 0, text).otherwise(_let(spans, lambda p: F.aggregate(_blocks(p), start, block(p), lambda s: F.array_join(s["out"], ""))))
