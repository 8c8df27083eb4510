"""Facts from the page text of filings, report choice and report verification.

Pages are rows (doc_id, page_no, text). Only the few pages of one section are ever joined into one string; phrases
across page breaks are found in a page with the strip that follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoweave.constraints import with_violations
from chronoweave.functions.latest import first_per_key, last_per_key
from chronoweave.functions.ordered import in_blocks, time_bucket
from chronoweave.functions.rows import row_array
from chronoweave.operators.funds import fund_code

# Phrases of the disclosure section.
CUSTOMER_TOTAL, SUPPLIER_TOTAL = "前五名客户合计销售金额", "前五名供应商合计采购金额"
CUSTOMER_HEAD, SUPPLIER_HEAD, SUPPLIER_TAIL = "公司主要销售客户情况", "公司主要供应商情况", "主要供应商其他情况说明"
PATTERNS = {
    "customer": {
        "amount": r"前五名客户合计销售金额（元）\s*([\d,]+\.\d{2})",
        "share": r"前五名客户合计销售金额占年度销售总额比例\s*([\d.]+)%",
        "related": r"前五名客户销售额中关联方销售额占年度销售总额比例\s*([\d.]+)%",
    },
    "supplier": {
        "amount": r"前五名供应商合计采购金额（元）\s*([\d,]+\.\d{2})",
        "share": r"前五名供应商合计采购金额占年度采购总额比例\s*([\d.]+)%",
        "related": r"前五名供应商采购额中关联方采购额占年度采购总额比例\s*([\d.]+)%",
    },
}
RANKED = r"(第[一二三四五]名)\s+([\d,]+\.\d{2})\s+([\d.]+)%"
ORDINALS = ["第一名", "第二名", "第三名", "第四名", "第五名"]
SHARE_CLASS_MARKERS = ["下属分级基金", "下属基金份额类别", "各类别基金份额"]
VERIFIED = "pdf_content_verified_against_index_and_disclosed_holdings"
INCOMPLETE = "pdf_downloaded_verification_incomplete"


def find_numbers(text: Column, pattern: str, group: int = 1) -> Column:
    """All numbers a pattern finds, thousands commas removed."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.transform(found, lambda item: F.replace(item, F.lit(","), F.lit("")).try_cast("double"))


def _first_number(text: Column, pattern: str) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(","), F.lit("")).try_cast("double")


def _after(text: Column, mark: str) -> Column:
    """Text after the first mark, null without one."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, at + len(mark), F.length(text)))


def _before(text: Column, mark: str) -> Column:
    """Text before the first mark, or the whole text."""
    at = F.locate(mark, text)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1)).otherwise(text)


def concentration_section(pages: DataFrame) -> DataFrame:
    """Per filing the whitespace-normalised section from the customer to the supplier totals."""
    places = pages.groupBy("doc_id").agg(
        F.min(F.when(F.contains("text", F.lit(CUSTOMER_TOTAL)), F.col("page_no"))).alias("customer_page"),
        F.min(F.when(F.contains("text", F.lit(SUPPLIER_TOTAL)), F.col("page_no"))).alias("supplier_page"),
    ).filter(F.col("customer_page").isNotNull() & F.col("supplier_page").isNotNull())
    chosen = pages.join(places, "doc_id").filter((F.col("page_no") >= F.col("customer_page")) & (F.col("page_no") <= F.col("supplier_page") + 1))
    joined = chosen.groupBy("doc_id", "customer_page", "supplier_page").agg(F.sort_array(F.collect_list(F.struct("page_no", "text"))).alias("_pages"))
    return joined.withColumn("section", F.regexp_replace(F.array_join(F.col("_pages.text"), "\n"), r"\s+", " ")).drop("_pages")


def extract_concentrations(pages: DataFrame) -> DataFrame:
    """One row per filing and side with the disclosed totals and the rules it breaks.

    Five anonymous ranked rows must add up to the disclosed total within 0.01. Ranked
    rows with other names need a human identity review and are rejected here.
    """
    sections = concentration_section(pages)
    customer = _before(_after(F.col("section"), CUSTOMER_HEAD), SUPPLIER_HEAD)
    supplier = _before(_after(F.col("section"), SUPPLIER_HEAD), SUPPLIER_TAIL)
    sides = row_array(["counterparty_side", "_text"], (F.lit("customer"), customer), (F.lit("supplier"), supplier))
    rows = sections.select("doc_id", "customer_page", "supplier_page", F.inline(sides))

    def of_side(name: str) -> Column:
        is_customer = F.col("counterparty_side") == "customer"
        return F.when(is_customer, _first_number(F.col("_text"), PATTERNS["customer"][name])).otherwise(_first_number(F.col("_text"), PATTERNS["supplier"][name]))

    amounts = find_numbers(F.col("_text"), RANKED, 2)
    facts = rows.withColumns({
        "aggregate_amount": of_side("amount"), "share_of_total": F.round(of_side("share") / 100, 10),
        "related_party_share_of_total": F.round(of_side("related") / 100, 10),
        "ranked_names": F.regexp_extract_all("_text", F.lit(RANKED), F.lit(1)), "ranked_amounts": amounts,
        "ranked_shares": F.transform(find_numbers(F.col("_text"), RANKED, 3), lambda share: F.round(share / 100, 10)),
        "evidence_pages": F.when(F.col("counterparty_side") == "customer", F.col("customer_page").cast("string")).otherwise(
            F.concat_ws("-", "supplier_page", F.col("supplier_page") + 1)),
    })
    total = F.aggregate("ranked_amounts", F.lit(0.0), lambda acc, x: acc + x)
    customers = F.col("counterparty_side") == "customer"
    quote = F.concat(
        F.when(customers, CUSTOMER_TOTAL).otherwise(SUPPLIER_TOTAL), F.lit("（元）"), F.format_number("aggregate_amount", 2), F.lit("；"),
        F.when(customers, "占年度销售总额比例 ").otherwise("占年度采购总额比例 "), F.format_string("%.2f%%", F.col("share_of_total") * 100),
        F.lit("；"), F.when(customers, "客户").otherwise("供应商"), F.lit("名称仅披露为第一名至第五名。"))
    return with_violations(facts, {
        "amount_missing": F.col("aggregate_amount").isNull(),
        "share_missing": F.col("share_of_total").isNull(),
        "related_share_missing": F.col("related_party_share_of_total").isNull(),
        "ranked_rows_not_five": F.coalesce(F.size("ranked_names"), F.lit(0)) != 5,
        "ranked_names_not_anonymous": F.size(F.array_except(F.lit(ORDINALS), F.coalesce("ranked_names", F.array().cast("array<string>")))) > 0,
        "ranked_sum_differs": F.abs(total - F.col("aggregate_amount")) > 0.01,
    }).withColumns({"names_disclosed": F.lit("false"), "evidence_quote": quote}).drop("_text")


# --- report choice -------------------------------------------------------------------------------------

def quarter_title(period_end: Column) -> Column:
    day = F.to_date(period_end)
    return F.concat(F.year(day).cast("string"), F.lit("年第"), F.quarter(day).cast("string"), F.lit("季度报告"))


def choose_reports(reports: DataFrame) -> DataFrame:
    """One report per fund and period: a quarterly title first, then the earliest announcement."""
    dated = reports.filter(F.col("report_period_end").isNotNull()).withColumn("fund_code", fund_code(F.col("fund_code")))
    preferred = F.when(F.contains("announcement_title", quarter_title(F.col("report_period_end"))), 0).otherwise(1)
    return first_per_key(dated, ["fund_code", "report_period_end"], [preferred, F.col("announcement_date"), F.col("source_record_id")])


def full_annual_reports(announcements: DataFrame, *, key: str = "symbol") -> DataFrame:
    """Latest announcement per key whose title, without markup, is exactly a full annual report."""
    plain = announcements.withColumn("title", F.regexp_replace("announcement_title", r"<[^>]+>", ""))
    full = plain.filter(F.col("title").rlike(r"^\d{4}年年度报告$")).withColumn("report_year", F.substring("title", 1, 4).cast("int"))
    return last_per_key(full, [key], [F.col("announcement_time"), F.col("announcement_id")])


# --- report verification ---------------------------------------------------------------------------------

def compact(text: Column) -> Column:
    """Text without white space and with ASCII brackets."""
    return F.translate(F.regexp_replace(text, r"\s+", ""), "（）", "()")


def name_aliases(name: Column) -> Column:
    """Compact name, without the listed-fund marker, and both without a share-class letter."""
    base = compact(name)
    bare = F.replace(base, F.lit("(LOF)"), F.lit(""))
    return F.filter(F.array_distinct(F.array(base, bare, F.regexp_replace(base, "[AC]$", ""), F.regexp_replace(bare, "[AC]$", ""))), lambda a: a != "")


def holding_matches(holdings: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that mention a holding by name, code, or code without leading zeros.

    Both tables carry doc_id, the key of the join: a holding is looked up in the pages of its own
    filing only. Adaptive execution splits the partition of a filing with very many of both.
    """
    code = F.substring_index("instrument_id", ".", 1)
    bare = F.regexp_replace(code, "^0+", "")
    spellings = F.array_distinct(F.array(compact(F.col("security_name")), code, F.when(bare == "", "0").otherwise(bare)))
    named = holdings.select("doc_id", "instrument_id", "security_name", spellings.alias("_spellings")).distinct()
    texts = pages.select("doc_id", "page_no", compact(F.col("text")).alias("_page"))
    hits = named.join(texts, "doc_id").filter(F.exists("_spellings", lambda needle: (needle != "") & F.contains(F.col("_page"), needle)))
    return hits.select("doc_id", "instrument_id", "security_name", "page_no").distinct()


def with_following(pages: DataFrame, width: int) -> DataFrame:
    """(doc_id, page_no, _look): the compact text of each page that has some, and the first ``width`` - 1 characters that follow it.

    What stands across a page break, or across several short pages, is found in ``_look`` of the page where it begins.
    Pages are ordered in blocks, so no task holds all pages of a filing, and no cell more than one page.
    """
    texts = pages.select("doc_id", "page_no", compact(F.col("text")).alias("_page")).filter("_page <> ''")
    if width < 2:
        return texts.withColumnRenamed("_page", "_look")
    blocks = in_blocks(texts, ["doc_id"], [F.col("page_no"), F.col("_page")], bucket=time_bucket(texts, "page_no"), after=width - 1)
    heads = F.collect_list(F.substring("_page", 1, width - 1)).over(blocks.window.rowsBetween(1, width - 1))
    strip = F.substring(F.array_join(heads, ""), 1, width - 1)
    return blocks.with_df(blocks.df.withColumn("_look", F.concat("_page", strip))).finish().select("doc_id", "page_no", "_look")


def page_facts(pages: DataFrame) -> DataFrame:
    """Per filing its pages, its characters with a line break between pages, and the six-digit codes on them."""
    filled = F.count("text")
    sizes = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"), F.when(filled > 0, F.sum(F.length("text")) + filled - 1).otherwise(0).cast("int").alias("text_character_count"))
    codes = pages.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<!\d)(\d{6})(?!\d)")))).alias("code")).distinct()
    held = codes.groupBy("doc_id").agg(F.array_sort(F.collect_set("code")).alias("six_digit_codes"))
    return sizes.join(held, "doc_id", "left").withColumn("six_digit_codes", F.coalesce("six_digit_codes", F.array().cast("array<string>")))


def verify_reports(documents: DataFrame, pages: DataFrame, holdings: DataFrame) -> DataFrame:
    """Verification record per filing.

    ``documents`` has doc_id, fund_code, fund_name, full_name and report_period_end;
    ``holdings`` has doc_id, instrument_id and security_name. Verified means the name,
    the code and the period occur and at least min(8, n) holdings were found. Names, codes and periods are looked
    up page by page with what follows on the next ones, and reduced to flags before they are brought together.
    """
    named = documents.withColumn("fund_code", fund_code(F.col("fund_code"))).withColumns({
        "_aliases": F.array_union(name_aliases(F.col("full_name")), name_aliases(F.col("fund_name"))), "_title": quarter_title(F.col("report_period_end"))})
    sought = ["doc_id", "_aliases", "fund_code", "_title"]
    longest = F.greatest(F.array_max(F.transform("_aliases", F.length)), F.length("fund_code"), F.length("_title"))
    width = max([named.agg(F.max(longest)).first()[0] or 0, *map(len, SHARE_CLASS_MARKERS)])  # one number, whatever the pages
    seen = lambda condition, name: F.coalesce(F.bool_or(condition), F.lit(False)).alias(name)
    look = F.col("_look")
    flags = with_following(pages, width).join(named.select(sought).distinct(), "doc_id").groupBy(sought).agg(
        seen(F.exists("_aliases", lambda alias: F.contains(look, alias)), "identity_name_match"),
        seen(F.contains(look, F.col("fund_code")), "fund_code_match"),
        seen(F.contains(look, F.col("_title")), "report_period_match"),
        seen(F.exists(F.lit(SHARE_CLASS_MARKERS), lambda mark: F.contains(look, mark)), "share_class_table_detected"))
    matches = holding_matches(holdings, pages)
    found = matches.groupBy("doc_id").agg(
        F.count_distinct("instrument_id").alias("matched_holding_rows"), F.sort_array(F.collect_set("page_no")).alias("holding_evidence_pages"))
    expected = holdings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("expected_holding_rows"))
    same = [F.col(name) == F.col(f"_of{name}") if name == "doc_id" else F.col(name).eqNullSafe(F.col(f"_of{name}")) for name in sought]
    found_flags = ["identity_name_match", "fund_code_match", "report_period_match", "share_class_table_detected"]
    keyed = flags.select(*[F.col(name).alias(f"_of{name}") for name in sought], *found_flags)
    flagged = named.join(keyed, same, "left").drop("_aliases", "_title", *[f"_of{name}" for name in sought])
    rows = flagged.join(page_facts(pages), "doc_id", "left").join(expected, "doc_id", "left").join(found, "doc_id", "left")
    checks = rows.fillna(0, ["expected_holding_rows", "matched_holding_rows", "page_count"]).fillna(False, found_flags)
    enough = F.col("matched_holding_rows") >= F.least(F.lit(8), F.col("expected_holding_rows"))
    verified = F.col("identity_name_match") & F.col("fund_code_match") & F.col("report_period_match") & enough
    return checks.withColumn("quality_status", F.when(verified, VERIFIED).otherwise(INCOMPLETE))
