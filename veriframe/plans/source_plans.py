"""Queries over streams, exact arithmetic and the advisory model."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.functions.exact import exact
from veriframe.operators import advisory
from veriframe.sources import archives, assessments, sinks
from veriframe.sources.tables import table
from veriframe.streaming import ledger


def exact_percent(spark, sf_dir: str) -> DataFrame:
    """Exact value of (1 - discount) * (1 + tax) written out as text."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_discount", "l_tax").agg(F.count("*").alias("n"))
    said = F.format_string("(100%% - %.0f%%) × (1 + %.2f)", F.col("l_discount") * 100, F.col("l_tax"))
    return li.withColumn("v", exact(said)).select(F.round(F.col("l_discount") * 100).cast("long").alias("discount"), F.round(F.col("l_tax") * 100).cast("long").alias("tax"), "n", F.col("v.text").alias("factor"))


def stream_latest(spark, sf_dir: str) -> DataFrame:
    """Latest event type per user from the stream of events."""
    stream = ledger.latest_values(ledger.read_stream(spark, f"{sf_dir}/events*.parquet"), "user_id", "event_id", "event_type")
    rows = ledger.run_available(stream, "update")
    last = Window.partitionBy("user_id").orderBy(F.desc("batch"))
    return rows.withColumn("place", F.row_number().over(last)).where("place = 1").select("user_id", "event_type", "event_id", "events")


def stream_once_each(spark, sf_dir: str) -> DataFrame:
    """Events per type after events of one user, type and value within the hour are taken once."""
    events = ledger.read_stream(spark, f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events = events.withColumn("key", F.concat_ws("|", F.date_trunc("hour", "ts"), "user_id", "event_type"))
    return ledger.run_available(ledger.once_each(events, "key", "ts")).groupBy("event_type").agg(F.count("*").alias("events"))


def stream_windows(spark, sf_dir: str) -> DataFrame:
    """Hourly counts that the watermark has closed; hours that end in its last ten minutes or later stay open."""
    events = ledger.read_stream(spark, f"{sf_dir}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    return ledger.run_available(ledger.windowed_counts(events, "ts", "event_type")).select("start", "event_type", "events")


_FEATURES = ["size", "breaks", "digits", "marks"]


def _reviews(spark, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null")
    share = lambda pattern: 1 - F.length(F.regexp_replace("text", pattern, "")) / F.greatest(F.length("text"), F.lit(1))
    return d.select(
        F.col("source").alias("group"), F.col("doc_id").alias("id"), F.col("quality").alias("label"), (F.log1p("n_chars") / 10).alias("size"), share(r"\n").alias("breaks"),
        share(r"[0-9]").alias("digits"), share(r"[#$%&*|!]").alias("marks"),
    )


def advisory_evaluation(spark, sf_dir: str) -> DataFrame:
    """Held-out evaluation of the advisory model; no rows where there is too little data."""
    reviews = _reviews(spark, sf_dir)
    model = advisory.train(reviews, _FEATURES)
    if model is None:
        none = advisory.AdvisoryModel((0.0,) * (len(_FEATURES) + 1), (None,), 0)
        return advisory.evaluation(reviews, none, _FEATURES).where(F.lit(False))
    return advisory.evaluation(reviews, model, _FEATURES)


def _packages(spark, sf_dir: str) -> DataFrame:
    """(path, content): packages of twenty products each, with a manifest that also names files which aren't there."""
    p = table(spark, sf_dir, "part").select(F.floor(F.col("p_partkey") / 20).alias("package"), "p_partkey", "p_name", "p_size")

    def write(group):
        import pandas as pd

        rows = group.sort_values("p_partkey")
        items = "".join(f'<item identifier="i{k}" identifierref="r{k}"><title>{name} &amp; more</title></item>' for k, name in zip(rows["p_partkey"], rows["p_name"], strict=True))
        resources = "".join(f'<resource identifier="r{k}" type="webcontent" href="f/{k}.txt"><file href="{"f" if size > 10 else "g"}/{k}.txt"/></resource>' for k, size in zip(rows["p_partkey"], rows["p_size"], strict=True))
        manifest = f'<manifest xmlns="x"><organizations><organization>{items}</organization></organizations><resources>{resources}<resource identifier="alone" type="x"/></resources></manifest>'
        parts = {"imsmanifest.xml": manifest} | {f"f/{k}.txt": f"{name}\n" * int(size) for k, name, size in zip(rows["p_partkey"], rows["p_name"], rows["p_size"], strict=True)}
        number, content = rows["package"].iloc[0], sinks.archive(parts)
        return pd.DataFrame({"path": [f"p{number}"], "content": [content if number % 10 else content[: len(content) // 2]]})

    return p.groupBy("package").applyInPandas(write, "path string, content binary")


def package_entries(spark, sf_dir: str) -> DataFrame:
    """Files of packages with their hashes; every tenth package is cut off."""
    rows = archives.entries_of(_packages(spark, sf_dir)).where("name is null or name != 'imsmanifest.xml'")
    return rows.select("package", "name", "size", "sha256", "problem")


def package_manifests(spark, sf_dir: str) -> DataFrame:
    """What manifests declare, by package: items, files that are missing, those of them that are elsewhere, orphans."""
    entries = archives.entries_of(_packages(spark, sf_dir))
    manifest = archives.manifest_rows(entries)
    items = manifest.groupBy("package").agg(F.count_if(F.col("kind") == "ITEM").alias("items"), F.min(F.when(F.col("kind") == "ITEM", F.col("title"))).alias("title"))
    lost = archives.missing_files(manifest, entries).groupBy("package").agg(F.count("*").alias("missing"), F.count_if("elsewhere").alias("elsewhere"))
    alone = archives.orphans(manifest).groupBy("package").agg(F.count("*").alias("orphans"))
    return items.join(lost, "package", "left").join(alone, "package", "left").na.fill(0)


def workbook_tables(spark, sf_dir: str) -> DataFrame:
    """Suppliers written as workbooks of one nation each, and read back by their headings."""
    s = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_name").alias("Supplier Name"), F.col("s_suppkey").cast("string").alias("KEY"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("=<"), F.floor("s_acctbal").cast("string"))).alias("Balance"))
    cells = archives.cells_of(sinks.workbooks(s, "s_nationkey", ["Supplier Name", "KEY", "Balance"]))
    rows = archives.table_of(cells, {"name": ("supplier name",), "key": (), "balance": ("account",)})
    return rows.select(F.regexp_extract("workbook", "^[0-9]+", 0).alias("nation"), "name", "key", "balance")


def csv_lines(spark, sf_dir: str) -> DataFrame:
    """Products as lines of delimited text with fields that a spreadsheet would run."""
    p = table(spark, sf_dir, "part")
    odd = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit("=1+"), "p_name")).when(F.col("p_size") % 5 == 1, F.concat(F.lit(' -say "'), F.col("p_name"), F.lit('", now'))).otherwise(F.col("p_name"))
    return p.select("p_partkey", sinks.csv_line([F.col("p_partkey"), odd, F.when(F.col("p_size") > 25, F.col("p_brand"))]).alias("line"))


def bank_questions(spark, sf_dir: str) -> DataFrame:
    """Products as questions of line banks, by brand; prompts and options hold commas."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    prompt = F.when(k % 3 == 0, F.concat(F.lit('QuestionText,"What, then, is '), F.col("p_name"), F.lit('?",HTML,,'))).when(k % 3 == 1, F.concat(F.lit("QuestionText,What, then, is "), F.col("p_name"), F.lit("?,,,"))).otherwise(F.lit("Title,x"))
    said = F.array(
        F.lit("NewQuestion,MC,HTML,,"), prompt, F.concat(F.lit("Option,100,"), F.col("p_type"), F.lit(", yes,,,")), F.when(F.col("p_size") > 10, F.lit("Option,0,no")), F.when(F.col("p_size") > 40, F.lit("Option,half,perhaps")),
    )
    lines = p.select("p_brand", k.alias("p"), F.posexplode(F.array_compact(said)).alias("at", "line")).select("p_brand", (F.col("p") * 10 + F.col("at")).alias("place"), "line")
    rows = assessments.bank_questions(lines, ["p_brand"])
    return rows.select("p_brand", "question", "kind", "prompt", F.concat_ws("|", F.col("options.text")).alias("options"), "right", "gaps", "state")


QUERIES = {f.__name__: f for f in (package_entries, package_manifests, workbook_tables, csv_lines, bank_questions, exact_percent, stream_latest, stream_once_each, stream_windows, advisory_evaluation)}

ORACLE_SQL = {
    "exact_percent": """SELECT round(l_discount * 100)::BIGINT AS discount, round(l_tax * 100)::BIGINT AS tax, count(*) AS n,
        ((100 - round(l_discount * 100)::BIGINT) * (100 + round(l_tax * 100)::BIGINT) / 10000.0)::DECIMAL(10, 4)::VARCHAR AS factor FROM lineitem GROUP BY l_discount, l_tax""",
    "stream_latest": "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id, count(*) AS events FROM events GROUP BY user_id",
    "stream_windows": """SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""",
    "stream_once_each": "SELECT event_type, count(*) AS events FROM (SELECT DISTINCT date_trunc('hour', ts), user_id, event_type FROM events) GROUP BY event_type",
    "package_entries": """WITH p AS (SELECT floor(p_partkey / 20)::BIGINT AS g, p_partkey AS k, repeat(p_name || chr(10), p_size::BIGINT) AS t FROM part)
        SELECT 'p' || g AS package, 'f/' || k || '.txt' AS name, strlen(t)::BIGINT AS size, sha256(t) AS sha256, NULL::VARCHAR AS problem FROM p WHERE g % 10 <> 0
        UNION ALL SELECT DISTINCT 'p' || g, NULL, NULL, NULL, 'BAD_ARCHIVE: BadZipFile' FROM p WHERE g % 10 = 0""",
    "package_manifests": """WITH p AS (SELECT floor(p_partkey / 20)::BIGINT AS g, p_name || ' & more' AS title, p_size FROM part)
        SELECT 'p' || g AS package, count(*) AS items, min(title) AS title, count(*) FILTER (p_size <= 10) AS missing, count(*) FILTER (p_size <= 10) AS elsewhere, 1::BIGINT AS orphans FROM p WHERE g % 10 <> 0 GROUP BY g""",
    "workbook_tables": """SELECT s_nationkey::VARCHAR AS nation, s_name AS name, s_suppkey::VARCHAR AS key, CASE WHEN s_acctbal > 0 THEN '=<' || floor(s_acctbal)::BIGINT END AS balance FROM supplier""",
    "csv_lines": """SELECT p_partkey, p_partkey || ',' || CASE p_size % 5 WHEN 0 THEN chr(39) || '=1+' || p_name WHEN 1 THEN '"' || chr(39) || ' -say ""' || p_name || '"", now"' ELSE p_name END || ',' || CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS line FROM part""",
    "bank_questions": """SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS question, 'MC' AS kind, CASE WHEN p_partkey % 3 < 2 THEN 'What, then, is ' || p_name || '?' END AS prompt,
        p_type || ', yes' || CASE WHEN p_size > 10 THEN '|no' ELSE '' END || CASE WHEN p_size > 40 THEN '|perhaps' ELSE '' END AS options, 1::BIGINT AS right,
        array_to_string(list_filter([CASE WHEN p_partkey % 3 = 2 THEN 'PROMPT' END, CASE WHEN p_size <= 10 THEN 'OPTIONS' END, CASE WHEN p_size > 40 THEN 'WEIGHT' END], lambda x: x IS NOT NULL), ',') AS gaps,
        CASE WHEN p_partkey % 3 < 2 AND p_size BETWEEN 11 AND 40 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS state FROM part""",
}
