"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score. Built-in SQL functions only.

Positions: ``split`` leaves the text between matches and ``regexp_extract_all`` the matches; running sums of both lengths are the
spans, in code points. Look-behinds and possessive repeats make every pattern try a run of its characters once, so long runs
without a match cost linear time; they find what the plain pattern finds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters before a span that are searched for context, and the score from which a span of an added kind counts.
REACH, THRESHOLD = 40, 0.75


def luhn(x: Column) -> Column:
    """From the right every second digit is doubled and its digits are added; the sum ends in 0."""
    n = F.length(x["d"])

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(x["d"], i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod_97(x: Column) -> Column:
    """The first four characters go to the end, letters become 10 to 35; the number modulo 97 is 1."""
    plain = F.regexp_replace(x["m"], " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    step = lambda rest, c: F.when(c == "", rest).when(c >= "A", (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + F.ascii(c) - 48) % 97)
    return (F.aggregate(F.split(turned, ""), F.lit(0), step) == 1) & F.length(plain).between(15, 34)


@dataclass(frozen=True)
class Kind:
    """``pattern`` proposes spans, ``valid`` confirms one (its match ``m`` and the digits ``d`` in it). A span scores ``score``, and
    ``bonus`` more with a word of ``context`` shortly before it. Without ``probe`` in the text there is no match."""

    name: str
    pattern: str
    probe: str
    base: bool
    valid: Callable[[Column], Column] | None
    score: float
    bonus: float
    context: str


KINDS = (
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, None, 0.9, 0.1, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", ".", True, lambda x: x["m"].rlike(r"^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(\.|$)){4}$"), 0.8, 0.2, "address|host|server"),
    # A maximal run of digits with single separators; runs of other lengths could never pass.
    Kind("card", r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])", "", True, luhn, 0.8, 0.2, "card|visa|credit|payment"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", "+", True, lambda x: F.length(x["d"]).between(9, 15), 0.8, 0.2, "phone|call|mobile"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", False, mod_97, 0.9, 0.1, "iban|account|bank"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", False, lambda x: ~x["m"].rlike("^(000|666|9)|-00-|-0000$"), 0.5, 0.4, "ssn|social security|tax number"),
)
SPAN = "array<struct<s:int,e:int,score:double>>"


def found_spans(df: DataFrame) -> DataFrame:
    """Adds, for each kind, ``_<kind>``: array of ``s, e`` (end exclusive) and ``score`` of the spans in ``_text`` that count."""
    for kind in KINDS:
        some = F.contains("_text", F.lit(kind.probe)) if kind.probe else F.lit(True)
        df = df.withColumn("_found", F.when(some, F.regexp_extract_all("_text", F.lit(kind.pattern), F.lit(0))))
        df = df.withColumn("_gaps", F.when(F.size("_found") > 0, F.split("_text", kind.pattern, -1)))
        df = df.withColumn(f"_{kind.name}", F.when(F.col("_gaps").isNotNull(), _confirmed(kind)).otherwise(F.array().cast(SPAN)))
    return df.drop("_found", "_gaps")


def _confirmed(kind: Kind) -> Column:
    def walk(acc: Column, i: Column) -> Column:
        match = F.get("_found", i)
        start = acc["at"] + F.length(F.get("_gaps", i))
        end = start + F.length(match)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("s"), end.alias("e"), match.alias("m"), F.regexp_replace(match, "[^0-9]", "").alias("d")))).alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int,m:string,d:string>>").alias("out"))
    spans = F.aggregate(F.sequence(F.lit(0), F.size("_found") - 1), nothing, walk, lambda acc: acc["out"])
    if kind.valid:
        spans = F.filter(spans, kind.valid)
    before = lambda x: F.substring("_text", F.greatest(x["s"] - REACH, F.lit(0)) + 1, F.least(x["s"], F.lit(REACH)))
    score = lambda x: F.when(before(x).rlike(f"(?i)(?:{kind.context})"), kind.score + kind.bonus).otherwise(kind.score)
    scored = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), score(x).alias("score")))
    return scored if kind.base else F.filter(scored, lambda x: x["score"] >= THRESHOLD)


def _each(kind: Kind, make: Callable[[Column, Kind], Column]) -> Column:
    return F.transform(f"_{kind.name}", lambda x: make(x, kind))


def _written(kinds: list[Kind]) -> Column:
    word = lambda x, kind: F.concat_ws(":", F.lit(kind.name), x["s"].cast("string"), x["e"].cast("string"))
    return F.array_join(F.concat(*(_each(k, word) for k in kinds)), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, top_score`` per row of ``docs`` (``doc_id``, ``text``).

    The counts and ``base_sha256`` are of the four base kinds, ``spans`` of all kinds: ``kind:start:end`` in code points, end
    exclusive, by kind as listed in ``KINDS``, then by start. ``top_score`` is the best score, null without spans. Null and empty
    texts have no spans; null ids are passed on; repeated rows are searched each; other columns are not read."""
    df = found_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text")))
    base = [k for k in KINDS if k.base]
    return df.select(
        "doc_id", *(F.size(f"_{k.name}").cast("long").alias(f"n_{k.name}") for k in base), F.sha2(_written(base), 256).alias("base_sha256"), _written(list(KINDS)).alias("spans"),
        F.array_max(F.transform(F.concat(*(F.col(f"_{k.name}") for k in KINDS)), lambda x: x["score"])).alias("top_score"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span that counts replaced by ``<KIND>`` in ``text``; overlapping spans go as one, under the first's name.

    All columns stay; ``n_chars``, if there, is the new length of a changed text. Texts without spans and nulls stay as they are."""
    df = found_spans(docs.withColumn("_text", F.coalesce(F.col("text").cast("string"), F.lit(""))))
    named = lambda x, kind: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(f"<{kind.name.upper()}>").alias("name"))
    df = df.withColumn("_spans", F.array_sort(F.concat(*(_each(k, named) for k in KINDS))))

    def cut(acc: Column, x: Column) -> Column:
        piece = F.concat(F.substring("_text", acc["at"] + 1, x["s"] - acc["at"]), x["name"])
        out = F.when(x["s"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), out.alias("out"))

    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    joined = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring("_text", acc["at"] + 1, F.length("_text")))
    df = df.withColumn("_new", F.when(F.size("_spans") > 0, F.aggregate("_spans", nothing, cut, joined)))
    out = {c: F.col(c) for c in docs.columns} | {"text": F.coalesce("_new", "text")}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.coalesce(F.length("_new").cast(docs.schema["n_chars"].dataType), "n_chars")
    return df.select(*(c.alias(name) for name, c in out.items()))
