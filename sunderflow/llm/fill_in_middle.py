"""Fill-in-middle transformation: documents as prefix, suffix and middle, cut between units.

A text is cut into units (a word with the white space before it, or white space at the end). Units are rows: they are
exploded with their ordinals, a window over a document's units adds their lengths up, the document's two cut requests
meet the units with their ordinals, and offsets are aggregated per document; substrings at the offsets make the output.
Whether a document is transformed, where it is cut and which form it takes follow from a hash of its doc_id.

Documents that stay plain need no offsets, so only the others are exploded. Their texts are dealt out once, by the document's
key (128 bits of doc_id and text); window, join, aggregation and the return to the text all work within that deal. A join by
key and ordinal would deal all units out anew, so it is one by key with the ordinal as its condition; a document's two
requests are one row, so a unit meets one row. A key has the units of one text, however many rows share it.

Null and empty texts are plain, as are texts that hold a mark. A null doc_id is hashed as the empty string. Rows that agree in
doc_id and text share a key: one of them is exploded, each gets the result. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from .common import F, Window, documents, durable, key128

UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SPM_SHARE = 42, 50, 80
_KEY = ["_h1", "_h2"]


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four 32-bit numbers from the hash of the seed and the document's id."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def form_of(text: Column, doc_id: Column, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> Column:
    """plain, spm or psm."""
    _, _, h3, h4 = draws(seed, doc_id)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    return F.when((text == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm_share, "spm").otherwise("psm")


def unit_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(UNIT)).cast("long")


def requests(rows: DataFrame, seed: int = SEED) -> DataFrame:
    """(key, doc_id, form, n, first, last), one row a key: the text's number of units, and after how many it is cut."""
    asked = rows.select(*_KEY, "doc_id", "form", unit_count(F.col("text")).alias("n"))
    cuts = [h % (F.col("n") + 1) for h in draws(seed, F.col("doc_id"))[:2]]
    asked = asked.select("*", F.least(*cuts).alias("first"), F.greatest(*cuts).alias("last"))
    return asked.groupBy(*_KEY).agg(*[F.min(c).alias(c) for c in ("doc_id", "form", "n", "first", "last")], F.count(F.lit(1)).alias("rows"))


def units(texts: DataFrame) -> DataFrame:
    """(key, ordinal, end): every unit of every text, from 1, and the code points up to its end; 0 ends at 0."""
    matches = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.col("text"), F.lit(UNIT), F.lit(0)))
    rows = texts.select(*_KEY, F.posexplode(matches).alias("ordinal", "_unit")).select(*_KEY, "ordinal", F.length("_unit").alias("_length"))
    upto = Window.partitionBy(*_KEY).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(*_KEY, "ordinal", F.sum("_length").over(upto).cast("int").alias("end"))


def offsets(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(key, doc_id, form, n, to_first, to_last): the code points before either cut. A key has one text."""
    at = {cut: F.col("ordinal") == F.col(cut) for cut in ("first", "last")}
    met = units(texts).join(asked, _KEY).where(at["first"] | at["last"])
    return met.groupBy(*_KEY).agg(*[F.max(c).alias(c) for c in ("doc_id", "form", "n")], *[F.max(F.when(met_it, F.col("end"))).alias(f"to_{cut}") for cut, met_it in at.items()])


def marked_up(text: Column, form: Column, to_first: Column, to_last: Column) -> Column:
    """The text in its form, with a mark before each piece."""
    prefix = F.substring(text, F.lit(1), to_first)
    middle = F.substring(text, to_first + 1, to_last - to_first)
    suffix = F.substring(text, to_last + 1, F.length(text))
    p, s, m = (F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE))
    return F.when(form == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. No mark can arise where a piece meets a mark, so splitting at them is exact."""
    piece = lambda i: F.get(F.split(output, "<[PSM]>", -1), F.lit(i))
    return F.when(form == "psm", F.concat(piece(1), piece(3), piece(2))).when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_share: int = SPM_SHARE) -> DataFrame:
    """One row per row of docs: doc_id, n, form, prefix_chars, middle_chars (null if plain) and output."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"))
    form = form_of(F.col("text"), F.col("doc_id"), seed, rate, spm_share)
    none = F.lit(None).cast("long")
    plain = rows.where(form == "plain").select("doc_id", unit_count(F.col("text")).alias("n"), F.lit("plain").alias("form"), none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    cut = rows.where(form != "plain").select("doc_id", "text", form.alias("form"), *key128(F.struct(F.col("doc_id").isNull(), "doc_id", "text")))
    asked = durable(requests(cut, seed), "fim-requests")
    texts = cut.select(*_KEY, "text")
    if asked.where("rows > 1").isEmpty():
        dealt = texts.repartition(*_KEY)
        met = dealt.join(offsets(dealt, asked), _KEY)
    else:
        found = offsets(texts.dropDuplicates(_KEY).repartition(*_KEY), asked)
        met = texts.join(durable(found, "fim-offsets"), _KEY)  # a table, so that the join can split a hot key
    first, last = F.col("to_first"), F.col("to_last")
    made = met.select("doc_id", "n", "form", first.cast("long").alias("prefix_chars"), (last - first).cast("long").alias("middle_chars"), marked_up(F.col("text"), F.col("form"), first, last).alias("output"))
    return plain.unionByName(made)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, form = F.col("output"), F.col("form")
    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(restored(out, form), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
h AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM t),
p AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS s FROM h)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
