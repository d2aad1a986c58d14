"""Personal data: spans of known forms, and others that occur in the same contexts. DataFrame functions only.

Known forms (email, ip, card, phone) come from regular expressions and their checks,
from left to right without overlap within a kind. Places are in code points, the end
exclusive. The expressions are written so that no text, however long or repetitive,
makes them backtrack or recurse: where a form repeats a separated group, separators
that can't belong to a match are first overwritten, one sign by one. Places are running
sums of lengths, taken in steps, so that many matches in one text stay cheap.

Contexts are learned by bootstrapping. A mention is a token (between blanks and the
signs of BREAK) that has a digit, or an inner sign of MARK, of whatever length; signs at
its ends (up to 8 in front) don't belong to it. Its patterns are the word, and the two words, before it, of
whatever length, with what is attached to it in front. A whole known entity is a seed
under the patterns of the token that it starts with; its other tokens are no mentions.
Over the graph of patterns and values, a pattern's confidence is the mean of its values',
weighed down by FEW, and a value's is the chance that any of its patterns is right, in
ROUNDS rounds. Patterns of at least SUPPORT distinct values and CONFIDENT confidence make
their other mentions spans of kind `id`, unless they touch a known form. So a pattern
whose slot holds many things that are not known to be personal stays without effect.

A null text is empty; a row keeps its place whatever its id, null and repeated ids too.
Output columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearthstat.llm.staging import stage

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
SUPPORT, CONFIDENT, FEW = 5, 0.7, 1.0
#: Numbers that are summed up at once.
STEP = 256

_LOCAL = "[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"[0-9]++(?:\.[0-9]++){3}"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Signs that end a token, and inner signs that make a mention of one without a digit.
BREAK = r'\s=:;,"<>|\[\]{}'
MARK = r"@()/%+_#*&$\\"
_SIGN = r"\p{L}\p{N}"
MENTION = (
    rf"(?<=(?:^|[{BREAK}])[^{BREAK}{_SIGN}+]{{0,8}})(?=[^{BREAK}]*?(?:[0-9]|[{MARK}][{_SIGN}]))"
    rf"[{_SIGN}+](?:[^{BREAK}]*[{_SIGN}])?"
)

SPANS = "array<struct<s:int,e:int,v:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often and in whatever loop the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(numbers: Column) -> Column:
    """For each number the sum of those before it.

    An array that grows by one is copied every time, hence the steps.
    """

    def sums(own: Column, start: Column) -> Column:
        empty = F.struct(start.alias("pos"), F.array().cast("array<int>").alias("out"))
        add = lambda state, x: F.struct((state["pos"] + x).alias("pos"), F.concat(state["out"], F.array(state["pos"])).alias("out"))
        return F.aggregate(own, empty, add, lambda state: state["out"])

    def stepped(n: Column) -> Column:
        last = F.floor((F.size(n) - 1) / STEP).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(n, i * STEP + 1, STEP))

    def whole(steps: Column) -> Column:
        totals = F.transform(steps, lambda x: F.aggregate(x, F.lit(0), lambda a, b: a + b))
        return F.flatten(F.zip_with(steps, sums(totals, F.lit(0)), sums))

    none = F.array().cast("array<int>")
    return _let(numbers, lambda n: F.when(F.size(n) > 0, _let(stepped(n), whole)).otherwise(none))


def _cut(text: Column, pattern: str) -> Column:
    """What lies between matches (a), and the matches that hold at least one sign each (m); they alternate in a text."""
    return F.struct(F.split(text, pattern, -1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))


def _spans(cut: Column) -> Column:
    """The matches with their places."""

    def placed(row: Column, before: Column) -> Column:
        start = before + F.length(row["a"])
        return F.struct(start.alias("s"), (start + F.length(row["v"])).alias("e"), row["v"].alias("v"))

    def spans(rows: Column) -> Column:
        starts = _running(F.transform(rows, lambda x: F.length(x["a"]) + F.length(x["v"])))
        return F.zip_with(rows, starts, placed)

    return _let(F.arrays_zip(F.slice(cut["a"], 1, F.size(cut["m"])).alias("a"), cut["m"].alias("v")), spans)


def _found(text: Column, pattern: str, ok=None) -> Column:
    spans = _let(_cut(text, pattern), _spans)
    return F.filter(spans, lambda x: ok(x["v"])) if ok else spans


def base_spans(text: Column) -> dict[str, Column]:
    """For each kind an array of (s, e, v)."""
    none = F.array().cast(SPANS)
    # A dot that no label follows can't be part of a domain; an underscore is like it in all but that.
    tied = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_")
    # Blanks and hyphens count only singly, between two digits.
    dense = F.regexp_replace(text, r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "x")
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    card = lambda v: F.length(digits(v)).between(16, 19) & F.call_function("luhn_check", digits(v))
    phone = lambda v: F.length(digits(v)).between(8, 15)
    ip = lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}\z")
    some = lambda asked, spans: F.when(asked, spans).otherwise(none)
    return {
        "email": some(F.contains(text, F.lit("@")), _found(tied, EMAIL)),
        "ip": some(text.rlike(r"[0-9]\.[0-9]"), _found(text, IP, ip)),
        "card": some(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), _found(dense, CARD, card)),
        "phone": some(F.contains(text, F.lit("+")), _found(text, PHONE, phone)),
    }


def _patterns(before: Column) -> Column:
    """The contexts of what follows this text: the word before it, and two, with what is attached to it."""

    def contexts(words: Column) -> Column:
        last = lambda n: F.get(words, F.size(words) - n)
        one = F.when(F.length(last(2)) > 0, F.concat(last(2), F.lit(" "), last(1)))
        two = F.when(F.length(last(3)) > 0, F.concat(last(3), F.lit(" "), one))
        return F.array_compact(F.array(F.when(F.length(last(1)) > 0, last(1)), one, two))

    return _let(F.split(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"\s+"), contexts)


def _mentions(text: Column) -> Column:
    """Tokens that may be identifiers, with their places and patterns."""

    def mentions(cut: Column) -> Column:
        part = lambda i: F.coalesce(F.get(cut["a"], i), F.lit(""))
        match = lambda i: F.coalesce(F.get(cut["m"], i), F.lit(""))
        # Two mentions back there are two words for certain.
        before = lambda i: F.concat(part(i - 2), match(i - 2), part(i - 1), match(i - 1), part(i))
        return F.transform(
            _spans(cut),
            lambda m, i: F.struct(
                m["s"].alias("s"), m["e"].alias("e"), F.lower(m["v"]).alias("value"), _patterns(before(i)).alias("patterns")
            ),
        )

    asked = text.rlike(rf"[0-9]|[{MARK}]")
    none = F.array().cast("array<struct<s:int,e:int,value:string,patterns:array<string>>>")
    return F.when(asked, _let(_cut(text, MENTION), mentions)).otherwise(none)


def _apart(rows: DataFrame) -> DataFrame:
    """(_row, s, e, value, seed, patterns) from rows (_row, _known, _m): mentions apart from known entities are
    no seeds, the one that an entity starts with stands for it, and the rest of its tokens are left out."""
    mentions = rows.where(F.size("_m") > 0).select("_row", (F.size("_known") > 0).alias("some"), F.explode("_m").alias("m"))
    mentions = mentions.select("_row", "some", "m.*")
    free = mentions.where("not some").select("_row", "s", "e", "value", F.lit(False).alias("seed"), "patterns")
    known = rows.where((F.size("_m") > 0) & (F.size("_known") > 0)).select("_row", F.explode("_known").alias("k"))
    marks = known.select("_row", "k.s", "k.e", F.lower("k.v").alias("value"), F.lit(True).alias("known"))
    marks = marks.unionByName(mentions.where("some").drop("some").withColumn("known", F.lit(False)), allowMissingColumns=True)
    # Both windows only run on, one in the order of places and one against it.
    onward = Window.partitionBy("_row").orderBy("s", F.desc("known"), "e").rowsBetween(Window.unboundedPreceding, 0)
    backward = Window.partitionBy("_row").orderBy(F.desc("s"), "known", F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    entity = F.when(F.col("known"), F.struct("e", "s", "value"))
    marks = marks.withColumns({
        "back": F.max(entity).over(onward),
        "next": F.min(F.when(F.col("known"), F.struct("s", "value"))).over(backward),
    }).where("not known")
    within = F.coalesce(F.col("back.e") > F.col("s"), F.lit(False))
    over = F.coalesce(F.col("next.s") < F.col("e"), F.lit(False))
    starts = (within & (F.col("s") - F.col("back.s") <= 2)) | (over & ~within)
    value = F.when(within, F.col("back.value")).when(over, F.col("next.value")).otherwise(F.col("value"))
    met = marks.where(starts | ~(within | over))
    return free.unionByName(met.select("_row", "s", "e", value.alias("value"), (within | over).alias("seed"), "patterns"))


def confident_patterns(mentions: DataFrame) -> DataFrame:
    """(pattern, confidence) for those to be trusted, from rows (value, seed, pattern)."""
    edges = stage(mentions.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
    # Only patterns of several values can be confirmed; the rest need not be carried along.
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SUPPORT)
    edges = stage(edges.join(sizes, "pattern"))
    seeds = edges.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("trust"))
    values = seeds
    for turn in range(ROUNDS):
        scored = edges.join(values, "value").groupBy("pattern", "n").agg(
            (F.sum("trust") / (F.col("n") + FEW)).alias("confidence")
        )
        scored = stage(scored)
        if turn == ROUNDS - 1:
            break
        doubt = F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(0.999999))))
        heard = edges.join(scored.select("pattern", "confidence"), "pattern").groupBy("value").agg(
            (1 - F.exp(doubt)).alias("trust")
        )
        values = stage(
            seeds.withColumnRenamed("trust", "seed").join(heard, "value", "left").select(
                "value", F.greatest("seed", F.coalesce("trust", F.lit(0.0))).alias("trust")
            )
        )
    return scored.where(F.col("confidence") >= CONFIDENT).select("pattern", "confidence")


def _named(kind: str) -> Column:
    return F.transform(f"_{kind}", lambda x: F.struct(F.lit(kind).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))


def find(docs: DataFrame) -> DataFrame:
    """`docs` without their text, and spans: (kind, s, e), the known kinds in order of KINDS, then `id`, by start."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rest = [c for c in docs.columns if c not in ("text", "spans")]
    base = base_spans(text)
    rows = docs.select(*rest, "text").withColumns({f"_{k}": base[k] for k in KINDS})
    known = F.concat(*(F.col(f"_{k}") for k in KINDS))
    plain = F.concat(*(_named(k) for k in KINDS))
    rows = rows.select(
        *rest, F.monotonically_increasing_id().alias("_row"), plain.alias("_base"), known.alias("_known"), _mentions(text).alias("_m")
    )
    rows = stage(rows)
    each = stage(_apart(rows)).withColumn("pattern", F.explode("patterns"))
    trusted = confident_patterns(each.select("value", "seed", "pattern"))
    new = each.where(~F.col("seed")).join(trusted, "pattern", "left_semi")
    new = new.groupBy("_row").agg(
        F.array_sort(F.collect_set(F.struct(F.lit("id").alias("kind"), F.col("s"), F.col("e")))).alias("_new")
    )
    added = F.coalesce(F.col("_new"), F.array().cast("array<struct<kind:string,s:int,e:int>>"))
    return rows.join(new, "_row", "left").select(*rest, F.concat("_base", added).alias("spans"))


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op4_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")
    of = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter(spans, lambda x: x["kind"] != "id")
    return find(docs).select(
        "doc_id", *(of(k) for k in KINDS), F.sha2(_digest(base), 256).alias("base_sha256"), _digest(spans).alias("spans")
    )
