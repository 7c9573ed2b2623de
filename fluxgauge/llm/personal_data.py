"""Personal data: candidate spans from regular expressions, chosen by rules and by gradient-boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fluxgauge.llm.common import stored
from fluxgauge.operators import blocks

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.99       # the threshold's precision on the held-out fifth of the candidates
BINS = 256             # split points of a feature; most features have fewer values
TREES, DEPTH = 12, 3
CONTEXT = 24           # characters kept on either side of a candidate


@dataclass(frozen=True)
class Generator:
    """A pattern that proposes spans. ``needs``: a text without this has none, which is cheaper to test."""
    kind: str
    base: bool
    pattern: str
    needs: str


# The base patterns of the four kinds. Possessive and anchored at the start of a run (or at the end of
# the match before), they match what the plain patterns match, in time linear in the text.
GENERATORS = (
    Generator("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Generator("ip", True, r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", "."),
    Generator("card", True, r"[0-9](?:[ -]?[0-9]){15,}+", ""),
    Generator("phone", True, r"\+[0-9][ ().0-9-]+[0-9]", "+"),
    # wider proposals, which overlap the base ones and each other; a possessive repeat needs no stack, however long
    Generator("email", False, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63}+)++", "at"),
    Generator("card", False, r"(?<![0-9])[0-9]{4}(?:[ ./-]{1,2}[0-9]{4}){3}(?![0-9])", ""),
    Generator("phone", False, r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .-]|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{4}(?![0-9.-])", ""),
)
# Words before a candidate that speak for its kind.
CUES = {"email": r"(?i)mail|contact|write", "ip": r"(?i)\bip\b|host|server|addr", "card": r"(?i)card|visa|credit|pay",
        "phone": r"(?i)tel|phone|call|fax|mobil"}


def _proposed(number: int, g: Generator) -> Column:
    """All matches of one generator with the length of the gap before each, and what stands around it."""
    text = F.col("text")
    there = F.contains(text, F.lit(g.needs)) if g.needs else F.lit(True)
    if g.kind != "email":
        there = there & F.col("digits")

    def placed(hits: Column, gaps: Column) -> Column:
        return F.transform(hits, lambda hit, i: F.struct(
            F.lit(number).alias("generator"), i.alias("nth"), hit.alias("hit"), F.length(F.get(gaps, i)).cast("long").alias("gap"),
            F.right(F.get(gaps, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(CONTEXT)).alias("after")))

    # Lambda variables hold the matches and the gaps: a text is split once, and not again for each of its matches.
    split = lambda hits: F.when(F.size(hits) > 0, F.array(F.split(text, g.pattern, -1))).otherwise(F.array().cast("array<array<string>>"))
    hits = F.when(there, F.array(F.regexp_extract_all(text, F.lit(g.pattern), F.lit(0)))).otherwise(F.array().cast("array<array<string>>"))
    return F.flatten(F.transform(hits, lambda found: F.flatten(F.transform(split(found), lambda gaps: placed(found, gaps)))))


def candidates(docs: DataFrame) -> DataFrame:
    """One row per proposed span with its place in code points, and one with generator null for a text without any.

    ``row`` tells documents apart, repeated ones too. A null text is empty.
    """
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "digits", F.rlike("text", F.lit("[0-9]")))
    found = numbered.select("row", "doc_id", F.explode_outer(F.concat(*[_proposed(i, g) for i, g in enumerate(GENERATORS)])).alias("c")).select(
        "row", "doc_id", "c.*")
    rows = stored(found, "pii-found")
    run = Window.partitionBy("row", "generator").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("hit")).over(run)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.length("hit"))


def luhn(digits: Column) -> Column:
    """Whether the sum of the digits, every second from the right doubled, is a multiple of ten."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), d.cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10 == 0


def described(rows: DataFrame) -> DataFrame:
    """Candidates with kind, the base rule's verdict, and the features the trees look at."""
    kinds = F.array(*[F.lit(g.kind) for g in GENERATORS])
    base = F.array(*[F.lit(g.base) for g in GENERATORS])
    at = F.col("generator") + 1
    digits = F.regexp_replace("hit", "[^0-9]", "")
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    size = F.length("digits")
    named = rows.where("generator is not null").withColumns({
        "kind": F.element_at(kinds, at), "base": F.element_at(base, at), "digits": digits})
    rule = F.when(F.col("kind") == "email", F.lit(True)).when(
        F.col("kind") == "ip", F.rlike("hit", F.lit(rf"^{octet}(?:\.{octet}){{3}}$"))).when(
        F.col("kind") == "card", F.when(size.between(16, 19), luhn(F.col("digits"))).otherwise(False)).otherwise(size.between(8, 15))
    number = lambda c: c.cast("double")
    features = {f"f_is_{k}": number(F.col("kind") == k) for k in KINDS} | {
        "f_digits": number(F.least(size, F.lit(40))), "f_length": number(F.least(F.length("hit"), F.lit(200))),
        "f_share": size / F.length("hit"), "f_plus": number(F.startswith(F.col("hit"), F.lit("+"))),
        "f_marks": number(F.least(F.length(F.regexp_replace("hit", "[^ ().-]", "")), F.lit(40))),
        "f_luhn": number(F.when(size.between(12, 19), luhn(F.col("digits"))).otherwise(False)),
        "f_ip": number(F.rlike("hit", F.lit(r"^[0-2]?[0-9]{1,2}(?:\.[0-2]?[0-9]{1,2}){3}$"))),
        "f_joined": number(F.rlike("before", F.lit(r"[\p{L}0-9]$")) | F.rlike("after", F.lit(r"^[\p{L}0-9]"))),
    } | {f"f_cue_{k}": number(F.rlike("before", F.lit(cue))) for k, cue in CUES.items()}
    return named.withColumn("rule", rule).withColumns(features)


def _threshold(checked: DataFrame) -> float | None:
    """The least probability (``p``) from which on labels are right at PRECISION; ``weight`` counts a row's candidates.

    Equal probabilities are accepted together. Running totals are taken in blocks of a ten-thousandth.
    """
    each = checked.groupBy(F.lit(0).alias("all"), "p").agg(
        F.sum(F.col("weight") * F.col("label")).alias("right"), F.sum("weight").alias("total"))
    so_far = blocks.running(each, ["all"], [-F.col("p")], F.floor((1 - F.col("p")) * 10_000), {
        "accepted_right": ("sum", F.col("right")), "accepted": ("sum", F.col("total"))})
    return so_far.where(F.col("accepted_right") >= PRECISION * F.col("accepted")).agg(F.min("p")).first()[0]


def _fit(labelled: DataFrame, names: list[str]):
    """Trees and threshold from all labelled candidates; None where one class is missing or precision isn't reached.

    Candidates with equal features and label are one row, whose weight is their number.
    """
    held = F.pmod(F.shiftright("draw", 20), F.lit(5)) == 0
    counted = stored(labelled.groupBy(*names, "label", held.alias("held")).agg(F.count("*").cast("double").alias("weight")), "pii-counted")
    known = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if min(known.get(0.0, 0), known.get(1.0, 0)) < 5:
        return None
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    rows = assembler.transform(counted)
    model = GBTClassifier(labelCol="label", featuresCol="features", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, maxBins=BINS, seed=1).fit(
        rows.where(~F.col("held")))
    threshold = _threshold(model.transform(rows.where("held")).select(vector_to_array("probability")[1].alias("p"), "label", "weight"))
    return None if threshold is None else (assembler, model, threshold)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points, the end exclusive.

    ``base`` has what the base patterns and their rules accept, leftmost and without overlap in each kind; ``spans`` has
    these and what the trees add. Wider proposals overlap them; one is added if its calibrated probability reaches the
    threshold and no accepted or earlier proposed span overlaps it. The trees learn the rules' verdicts from format and
    context, on all base candidates; with fewer than five examples of a class, nothing is added. A null text is empty.
    Every row gets an answer, repeated rows and rows without doc_id too; an empty table gives no rows. Other columns are
    not read. No text is shuffled, only candidates.
    """
    located = stored(candidates(docs), "pii-candidates")
    rows = described(located)
    names = [c for c in rows.columns if c.startswith("f_")]
    draw = F.xxhash64(F.lit(5), "row", "generator", "nth")
    fitted = _fit(rows.where("base").select(F.col("rule").cast("double").alias("label"), *names, draw.alias("draw")), names)
    accepted = rows.where("base and rule").select("row", "doc_id", "kind", "start", "end", F.lit(0).alias("added"))
    empty = located.where("generator is null or nth = 0").select("row", "doc_id", F.lit(None).cast("string").alias("kind"),
                                                               F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"), F.lit(2).alias("added"))
    spans = accepted
    if fitted:
        assembler, model, threshold = fitted
        likely = model.transform(assembler.transform(rows.where("not base").select("row", "doc_id", "kind", "start", "end", *names))).where(
            vector_to_array("probability")[1] >= threshold).select("row", "doc_id", "kind", "start", "end", F.lit(1).alias("added"))
        order = Window.partitionBy("row").orderBy("start", "added", "end")
        earlier, later = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
        spans = accepted.union(likely).select(
            "*", F.max("end").over(earlier).alias("reached"),
            F.min(F.when(F.col("added") == 0, F.col("start"))).over(later).alias("next")).where(
            "added = 0 or (coalesce(reached, 0) <= start and coalesce(next, end) >= end)").drop("reached", "next")
    span = F.struct("kind", "start", "end")
    ordered = lambda condition: F.array_sort(F.collect_list(F.when(condition, F.struct(
        F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).alias("nth"), "start", "end", span.alias("span")))))
    return spans.union(empty).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), ordered(F.col("added") == 0).alias("b"), ordered(F.col("added") < 2).alias("s")).select(
        "doc_id", F.col("b.span").alias("base"), F.col("s.span").alias("spans"))


def written(spans: Column) -> Column:
    """kind:start:end of every span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
