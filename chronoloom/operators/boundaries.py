"""Which page opens a document, and which pages belong together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.ordered import first_by, running
from ..rules import Pack
from ..session import cut
from .pages import PAGE, READABLE, transmissions

# --- Fixed values ---------------------------------------------------------------------------
START_AT = 0.5
TOP_BAND = 0.4
SERIAL = r"\bformulaire\s*n?[°o]?\s*(\d{3,5})\b"
SERIAL_REVISION = r"\b(\d{4})\s*\(\s*(\d{4}-\d{2})\s*\)"
LABEL_OF = r"^\s*(?:p(?:age)?\.?\s*)?(\d{1,4})\s*(?:de|of|/|sur)\s*(\d{1,4})\s*$"
SIGNED_BY = r"\bpar\s*:?\s*(.+)$"
SIGNING_WORDS = (
    r"^\s*(sign[ée]e?|approuv[ée]e?)\s*(électroniquement|numériquement)?\s*(par|:)?\s*"
)
AUTHOR_TRIM = " .:,"
#: What each signal adds to the evidence that a page opens a document, in tenths.
WEIGHTS = {"declares": 7, "heading": 5, "serial": 3, "label_first": 4, "label_later": -7,
           "banner_first": 5}
#: Pages per chunk of the ordered passes.
CHUNK_PAGES = 4096
# -------------------------------------------------------------------------------------------


def _author(text):
    named = F.nullif(F.btrim(tx.group(text, SIGNED_BY), F.lit(AUTHOR_TRIM)), F.lit(""))
    bare = F.nullif(
        F.btrim(F.regexp_replace(text, tx.rx(SIGNING_WORDS), ""), F.lit(AUTHOR_TRIM)), F.lit("")
    )
    return F.when(tx.hits(text, SIGNED_BY), named).otherwise(bare)


def page_signals(blocks: DataFrame, pages: DataFrame, pack: Pack) -> DataFrame:
    """Everything a page says about opening, continuing or naming a document.

    Blocks are reduced to one row per page in a single aggregation; pages without blocks stay.
    """
    text = F.col("text")
    near_top = F.col("y0") <= F.col("page_height") * TOP_BAND
    declares = [p for c in pack.classes for p in c.get("declares", [])]
    headings = [p for c in pack.classes for p in c.get("headings", [])]
    kind = F.col("type")
    revised = F.contains(text, F.lit("(")) & tx.hits(text, SERIAL_REVISION)
    named = F.contains(F.lower(text), F.lit("formulaire")) & tx.hits(text, SERIAL)
    serial = F.when(revised, F.struct(
        tx.group(text, SERIAL_REVISION, 1).alias("serial"),
        tx.group(text, SERIAL_REVISION, 2).alias("revision"))
    ).when(named, F.struct(
        tx.group(text, SERIAL, 1).alias("serial"), F.lit(None).cast("string").alias("revision")))
    position = F.when((kind == "page_label") & tx.hits(text, LABEL_OF), F.struct(
        tx.group(text, LABEL_OF, 1).cast("int").alias("k"),
        tx.group(text, LABEL_OF, 2).cast("int").alias("n")))
    signed = F.when(kind == "signature", F.struct(_author(text).alias("name")))
    told = blocks.select(
        "case_id", *PAGE, "ord",
        (near_top & tx.hits_any(text, declares)).alias("declares"),
        ((kind == "heading") & near_top & tx.hits_any(text, headings)).alias("heading"),
        serial.alias("form"), position.alias("label_of"), signed.alias("signed"),
        tx.counted_words(blocks.columns).alias("w"),
    )
    read = told.groupBy(*PAGE).agg(
        F.bool_or("declares").alias("declares"), F.bool_or("heading").alias("heading"),
        first_by(F.col("form"), F.col("ord")).alias("form"),
        first_by(F.col("label_of"), F.col("ord")).alias("label_of"),
        first_by(F.col("signed"), F.col("ord")).alias("signed"),
        F.sum("w.good").alias("good"), F.sum("w.alpha").alias("alpha"),
    )
    faxed = transmissions(blocks).select(
        *PAGE, F.struct(
            F.concat_ws("#", "sent", F.col("total").cast("string")).alias("key"),
            "position", "total").alias("banner"))
    every = (
        pages.select("case_id", *PAGE).join(read, PAGE, "left").join(faxed, PAGE, "left")
    )
    empty = F.col("good").isNull()
    quality = tx.share(F.col("good"), F.col("alpha"))
    label_first = F.col("label_of.k") == 1
    opens = F.col("banner.position") == 1

    def add(name, when):
        return F.when(when, WEIGHTS[name]).otherwise(0)

    tenths = (
        add("declares", F.col("declares")) + add("heading", F.col("heading"))
        + add("serial", F.col("form").isNotNull()) + add("label_first", label_first)
        + add("label_later", F.col("label_of").isNotNull() & ~label_first)
        + add("banner_first", opens)
    )
    readable = ~empty & (quality >= READABLE)
    reasons = F.array_compact(F.array(
        F.when(empty, F.lit("blank page")),
        F.when(F.col("declares"), F.lit("names its own class near the top")),
        F.when(F.col("heading"), F.lit("class heading near the top")),
        F.when(F.col("form").isNotNull(), F.concat(F.lit("form serial "), F.col("form.serial"))),
        F.when(label_first, F.format_string("label opens a document (1 of %d)", "label_of.n")),
        F.when(F.col("label_of").isNotNull() & ~label_first, F.format_string(
            "label continues a document (%d of %d)", "label_of.k", "label_of.n")),
        F.when(opens, F.concat(F.lit("first sheet of transmission "), F.col("banner.key"))),
        F.when(~empty & ~readable, F.lit("text does not read as words")),
    ))
    return every.select(
        "case_id", *PAGE,
        F.when(empty, F.lit(1.0)).otherwise(tenths / 10).alias("score"),
        (empty | (tenths >= int(START_AT * 10)) | ~readable).alias("starts"),
        readable.alias("readable"), empty.alias("empty"), quality.alias("quality"),
        "label_of", F.col("form.serial").alias("serial"), F.col("form.revision").alias("revision"),
        F.col("signed.name").alias("author"), "banner", reasons.alias("reasons"),
    )


def group_pages(signals: DataFrame) -> DataFrame:
    """Signals with ``group_start``, the first page of the run a page belongs to.

    A bundle may be any size: pages are handled in chunks along the page order.  The table of
    signals, one slim row per page, is written once as the passes read it more than once.
    """
    signals = cut(signals)
    here = F.struct("pdf_index", "readable", "label_of", "banner")
    chunk = F.floor(F.col("pdf_index") / CHUNK_PAGES)
    seen = running(signals, ["bundle_id"], ["pdf_index"], chunk=chunk, befores={"prev": here})
    prev = F.col("prev")
    any_banner = F.col("banner").isNotNull() | prev["banner"].isNotNull()
    next_sheet = F.coalesce(
        (F.col("banner.key") == prev["banner"]["key"])
        & (F.col("banner.position") == prev["banner"]["position"] + 1), F.lit(False))
    both_labelled = F.col("label_of").isNotNull() & prev["label_of"].isNotNull()
    next_label = F.coalesce(
        (F.col("label_of.n") == prev["label_of"]["n"])
        & (F.col("label_of.k") == prev["label_of"]["k"] + 1), F.lit(False))
    goes_on = (
        F.when(prev.isNull() | ~F.col("readable") | ~prev["readable"], F.lit(False))
        .when(any_banner, next_sheet)
        .when(both_labelled, next_label)
        .otherwise(F.lit(True))
    )
    opened = seen.withColumn("opens", F.col("starts") | ~goes_on)
    return cut(running(
        opened, ["bundle_id"], ["pdf_index"], chunk=chunk,
        lasts={"group_start": F.when(F.col("opens"), F.col("pdf_index"))},
    ))


def missing_sheets(grouped: DataFrame) -> DataFrame:
    """Sheets a fax counted but the bundle does not hold, between neighbouring pages."""
    prev, banner = F.col("prev"), F.col("banner")
    absent = banner["position"] - prev["banner"]["position"] - 1
    return grouped.filter(
        (banner["key"] == prev["banner"]["key"]) & (absent > 0)
    ).select(
        "bundle_id", banner["key"].alias("transmission"),
        prev["pdf_index"].alias("after_page"), absent.alias("missing"),
        banner["total"].alias("expected_total"),
    )
