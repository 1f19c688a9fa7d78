"""License scan by MinHash bands over overlapping text windows, in DataFrame functions only.

A document's words give hashed shingles of five. Templates fall into classes of lengths up to a power of two; for each
class the document is cut into overlapping windows (step: a quarter of the class's length) of which one holds any
occurrence whole. Windows with no shingle of any template of the class contain nothing and are skipped; of the others
MinHash bands retrieve templates of the class, and exact shingle containment of the template in the window decides. The
number of bands makes a window that contains CONTAINMENT of a template meet it with a probability of COLLISION or more.
Long documents are cut into segments first, so that no row grows with its windows.

Defined results: a null text has no words; repeated rows (same doc_id and text) count once; a null doc_id is a key of
its own; extra columns are ignored; an empty table gives an empty result; templates need five words or more and are
known by (license, text); of windows with equal containment the first counts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.license_texts import TEMPLATES
from loomspark.session import fence, materialize

SHINGLE = 5
CONTAINMENT = 0.8
ROWS = 1
COLLISION = 0.999
#: Shingles of a segment, or as many as the longest class has: a power of two, so that windows of all classes start alike
#: in each segment.
SEGMENT = 4096


def bands_for(similarity: float, rows: int = ROWS, probability: float = COLLISION) -> int:
    """Bands of `rows` hashes with which sets of that Jaccard similarity collide with the given probability."""
    return 1 if similarity >= 1 else math.ceil(math.log(1 - probability) / math.log(1 - similarity**rows))


def shingled(texts: DataFrame) -> DataFrame:
    """texts with `shingles`: hashes of all runs of five words, by place."""
    words = fence(texts, words=F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[\\p{L}\\p{N}]+"), F.lit(0)))
    hashed = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, SHINGLE)]))
    return fence(words.drop("text"), shingles=F.slice(hashed, 1, F.greatest(F.size("words") - (SHINGLE - 1), F.lit(0)))).drop("words")


def _signature(shingles: Column, bands: int) -> Column:
    low = lambda i: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, i)))
    mins = F.transform(F.sequence(F.lit(0), F.lit(bands * ROWS - 1)), low)
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.xxhash64(b, F.slice(mins, b * ROWS + 1, ROWS)))


def load_templates(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template, license, n, class, shingles): n is the number of shingles, repeats included, class the next power of two."""
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    sized = shingled(rows).withColumn("n", F.size("shingles"))
    found = materialize(sized.withColumn("class", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n").cast("double")))).cast("int")), "templates")
    if not found.where("n = 0").isEmpty():
        raise ValueError("templates need five words or more")
    return found


def steps(class_: int) -> tuple[int, int]:
    """Step and width of the windows of a class."""
    step = max(1, class_ // 4)
    return step, class_ + step - 1


def license_scan(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, text_hash, license, containment, first_word): the best window of each document and license."""
    spark = docs.sparkSession
    known = load_templates(spark, templates)
    # The templates are given by the caller; their shingles are a set in the plan, by class.
    values: dict[int, set[int]] = {}
    least: dict[int, float] = {}
    for row in known.select("class", "shingles").collect():
        own = set(row["shingles"])
        values.setdefault(row["class"], set()).update(own)
        similarity = containment * len(own) / (steps(row["class"])[1] + (1 - containment) * len(own))
        least[row["class"]] = min(1.0, similarity, least.get(row["class"], 1.0))
    bands = {c: bands_for(s) for c, s in least.items()}
    widest = max(steps(c)[1] for c in values)
    segment = max(SEGMENT, *values)

    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    every = sorted(set().union(*values.values()))
    rows = shingled(rows).where(F.exists("shingles", lambda x: x.isin(every)))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("shingles") - 1) / segment).cast("int")), lambda s: F.slice("shingles", s * segment + 1, F.lit(segment + widest)))
    rows = rows.select("doc_id", "text_hash", F.posexplode(cut).alias("segment", "shingles"))

    def windows_of(class_: int) -> Column:
        step, width = steps(class_)
        places = F.filter(F.transform("shingles", lambda x, i: F.when(x.isin(sorted(values[class_])), i)), lambda i: i.isNotNull())
        first = lambda p: F.greatest(F.lit(0), F.ceil((p - width + 1) / step)).cast("int")
        own = F.flatten(F.transform(places, lambda p: F.sequence(first(p), F.floor(p / step).cast("int"))))
        own = F.filter(F.array_distinct(own), lambda j: j * step < segment)
        return F.transform(own, lambda j: F.struct(F.lit(class_).alias("class"), (F.col("segment") * segment + j * step).alias("at"), F.array_distinct(F.slice("shingles", j * step + 1, width)).alias("window")))

    held = rows.select("doc_id", "text_hash", F.explode(F.concat(*map(windows_of, sorted(values)))).alias("w")).select("doc_id", "text_hash", "w.*")
    held = held.repartition(max(32, int(spark.conf.get("spark.sql.shuffle.partitions"))), "doc_id", "at")  # few bytes, much work

    def keys_of(shingles: str) -> Column:
        out = F.lit(None).cast("array<long>")
        for class_, n in bands.items():
            out = F.when(F.col("class") == class_, _signature(F.col(shingles), n)).otherwise(out)
        return out

    held = fence(held, keys=keys_of("window"))
    own = known.select("template", "class", F.explode(keys_of("shingles")).alias("key"))
    exact = known.select("template", "license", F.array_distinct("shingles").alias("shingles"))
    met = held.select("doc_id", "text_hash", "class", "at", "window", F.explode("keys").alias("key")).join(own, ["class", "key"])
    met = met.join(exact, "template").withColumn("containment", F.size(F.array_intersect("window", "shingles")) / F.size("shingles")).where(F.col("containment") >= containment)
    best = F.max(F.struct("containment", (-F.col("at")).alias("back"))).alias("best")
    return met.groupBy("doc_id", "text_hash", "license").agg(best).select("doc_id", "text_hash", "license", F.col("best.containment").alias("containment"), (-F.col("best.back")).alias("first_word"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    found = license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "license", F.round("containment", 6).alias("containment"), F.col("first_word").cast("long").alias("first_word"))


def _values() -> str:
    return ", ".join(f"({i}, '{name}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (name, text) in enumerate(TEMPLATES))


OP1_SQL = f"""
WITH t AS (SELECT * FROM (VALUES {_values()}) v(template, license, text)),
tw AS (SELECT template, license, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM t),
ts AS (SELECT template, license, len(w) - 4 AS n, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM tw),
tc AS (SELECT template, any_value(license) AS license, CAST(pow(2, ceil(log2(any_value(n)))) AS BIGINT) AS class, count(DISTINCT s) AS distinct_n FROM ts GROUP BY template),
tn AS (SELECT *, greatest(1, class // 4) AS step, class + greatest(1, class // 4) - 1 AS width FROM tc),
d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
dw AS (SELECT doc_id, text, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM d),
ds AS (SELECT doc_id, text, unnest(range(0, len(w) - 4)) AS p, unnest(list_transform(range(1, len(w) - 3), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS s FROM dw WHERE len(w) > 4),
h AS (SELECT DISTINCT ds.doc_id, ds.text, ds.p, ts.template, ds.s FROM ds JOIN ts ON ds.s = ts.s),
w AS (
  SELECT h.doc_id, h.text, h.template, h.s, unnest(range(greatest(0, CAST(ceil((p - width + 1) / step) AS BIGINT)), p // step + 1)) * step AS place
  FROM h JOIN tn USING (template)),
c AS (
  SELECT w.doc_id, w.text, license, place, count(DISTINCT s) / any_value(distinct_n) AS containment
  FROM w JOIN tn USING (template) GROUP BY w.doc_id, w.text, template, license, place HAVING count(DISTINCT s) / any_value(distinct_n) >= {CONTAINMENT}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text, license ORDER BY containment DESC, place) AS k FROM c)
SELECT doc_id, license, round(containment, 6) AS containment, place AS first_word FROM r WHERE k = 1
"""
