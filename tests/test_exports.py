"""Documents written as fragments: byte for byte what the collected objects and lines say."""

import uuid

from pyspark.sql import functions as F

from chronoloom import rules
from chronoloom.session import cut, shared_folder
from chronoloom.sinks import export, fragments

PACK = rules.load("cnesst")


def tables(spark):
    """Two cases of forty rows; one row holds nearly all lines, some have none."""
    rows = spark.range(40).select(
        F.format_string("row_%02d", "id").alias("row_id"), F.when(F.col("id") % 2 == 0, "c/1").otherwise("c 2").alias("case_id"),
        F.when(F.col("id") % 5 > 0, F.expr("date_add(date'2020-01-01', cast(id % 7 as int))")).alias("row_date"),
        F.lit("resolved").alias("date_status"), F.when(F.col("id") % 3 == 0, 'say "é"\n').alias("date_explanation"),
        F.array().cast("array<date>").alias("date_alternatives"), F.lit("Titre").alias("title"),
        F.when(F.col("id") % 4 == 0, "Dr X").alias("author"), F.lit("note").alias("doc_class"), F.lit("cnesst").alias("regime"),
        (F.col("id") / 40).alias("confidence"), F.lit(False).alias("warns"), F.lit(None).cast("string").alias("illegible_reason"),
        F.lit(False).alias("second_hand"), F.lit(1).cast("long").alias("n_units"),
        F.when(F.col("id") % 11 == 10, "rule.x").alias("excluded_by"), F.col("id").cast("int").alias("min_page"),
        F.lit("2020").alias("date_cell"), F.concat(F.lit("T"), F.col("id").cast("string")).alias("title_cell"),
        F.when(F.col("id") % 6 == 0, "Illisible").alias("illegible_cell"),
        F.when(F.col("id") % 7 == 0, "⚠").alias("warning_cell"))
    hot = F.when(F.col("id") % 10 < 8, 4).otherwise(F.col("id") % 30)
    bullets = spark.range(20_000).select(
        F.format_string("row_%02d", hot.cast("long")).alias("row_id"), F.col("id").alias("pos"),
        F.concat(F.lit('ligne "'), F.col("id").cast("string"), F.lit('" é')).alias("text"), F.lit(1.0).alias("confidence"),
        F.lit("r").alias("rule"), F.lit("b").alias("bundle_id"), F.lit(1).alias("pdf_index"), F.lit("u").alias("unit_id"),
        F.lit("k").alias("block_id"), F.lit(0).alias("span_start"), F.lit(None).cast("int").alias("span_end"))
    locators = spark.range(60).select(
        F.format_string("row_%02d", F.col("id") % 35).alias("row_id"), F.lit("x").alias("case_id"), F.col("id").alias("pos"),
        F.lit("Dossier").alias("folder_label"), F.lit("b").alias("bundle_id"), F.col("id").cast("int").alias("first_page"),
        F.lit(None).cast("string").alias("printed_label"), F.col("id").cast("string").alias("display_page"),
        F.lit(True).alias("flagged"), F.lit("u").alias("unit_id"), F.concat(F.lit("Dossier\np. "), F.col("id").cast("string")).alias("locator"))
    return cut(rows), cut(locators), cut(bullets)


def text_of(path, document):
    return b"".join(next(fragments.read(path, [document]))[1]).decode()


def test_streamed_documents_equal_the_collected_ones(spark):
    rows, locators, bullets = tables(spark)
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    fragments.write(fragments.json_fragments(rows, locators, bullets), f"{root}/json")
    want = export.json_rows(rows, locators, bullets)
    for case in ("c/1", "c 2"):
        lines = text_of(f"{root}/json", case).splitlines()
        assert lines == want.where(F.col("case_id") == case).orderBy("id").toJSON().collect()
    fragments.write(fragments.markdown_fragments(rows, locators, bullets, PACK), f"{root}/md")
    lines = export.markdown_lines(rows, locators, bullets, PACK).orderBy("case_id", "section", "row_sort", "part").collect()
    for case in ("c/1", "c 2"):
        assert text_of(f"{root}/md", case) == "".join(r["line"] + "\n" for r in lines if r["case_id"] == case)
    told = fragments.digests(spark.createDataFrame([("c/1",), ("none",)], "document string"), f"{root}/md").collect()
    assert {r["document"]: r["n_bytes"] for r in told} == {"c/1": len(text_of(f"{root}/md", "c/1").encode()), "none": 0}


def test_only_the_files_of_the_last_whole_run_are_read(spark):
    schema = "case_id string, section int, row_sort string, part int, piece int, pos long, text string"
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    fragments.write(spark.createDataFrame([("a", 0, None, 0, 0, 0, "old")], schema), path)
    fragments.write(spark.createDataFrame([("a", 0, None, 0, 0, i, f"{i},") for i in range(300)], schema).repartition(8), path)
    assert text_of(path, "a") == "".join(f"{i}," for i in range(300))
    # A run whose tasks wrote, but that was never committed.
    writer = fragments.FragmentWriter(path)
    system, root = fragments._system(path)
    with system.open_output_stream(f"{root}/document=a/{writer.run}-0000000-lost") as out:
        out.write(b"lost")
    assert text_of(path, "a") == "".join(f"{i}," for i in range(300))
