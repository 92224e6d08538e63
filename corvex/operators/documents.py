"""Documents from source packages: four kinds of records, their joins, and merged packages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classify import authority_profile, infer_facet, infer_task_kind
from ..functions.dates import date_confidence, date_kind, infer_academic_year, infer_term, infer_version_date, normalize_iso_date
from ..functions.text import canonical_title, clean_text, doc_host, normalize_text, sha1_text, summarize, unique_strings



def last_of(rows: DataFrame, key: str) -> DataFrame:
    """The last row of each key by ordinal."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "ordinal").alias("r")).select(key, "r.*")


def first_of(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), "ordinal").alias("r")).select(key, "r.*")


def sections_of(sections: DataFrame) -> DataFrame:
    """section_id, section, nav_path and tags; a repeated id keeps its last row."""
    clean = sections.withColumn("section_id", clean_text("section_id"))
    rows = last_of(clean, "section_id")
    path = F.filter(F.transform(F.coalesce("nav_path", F.array().cast("array<string>")), clean_text), lambda x: x != "")
    name, own = clean_text("name"), clean_text("section_id")
    path = F.when(F.size(path) > 0, path).otherwise(F.array(F.when(name != "", name).otherwise(own)))
    tags = F.filter(F.transform(F.coalesce("business_tags", F.array().cast("array<string>")), clean_text), lambda x: x != "")
    return rows.select("section_id", F.when(name != "", name).otherwise(F.element_at(path, -1)).alias("section"), path.alias("nav_path"), tags.alias("section_tags"))


def with_section(rows: DataFrame, sections: DataFrame) -> DataFrame:
    """Left join on section_id; rows without a section are on the home page."""
    out = rows.join(sections, "section_id", "left")
    return out.withColumns({"section": F.coalesce("section", F.lit("首页")), "nav_path": F.coalesce("nav_path", F.array(F.lit("首页"))), "section_tags": F.coalesce("section_tags", F.array().cast("array<string>"))})


def attachments_of(attachments: DataFrame) -> DataFrame:
    clean = {c: clean_text(c) for c in ("attachment_id", "name", "url", "extension", "parent_url")}
    return attachments.withColumns(clean).withColumn("evidence", F.lit("metadata_only"))


def nested_attachments(pages: DataFrame, attachments: DataFrame) -> DataFrame:
    """pages with their attachments as an array in input order, empty for pages without."""
    fields = F.struct("ordinal", "name", "extension", "section", "url", "parent_url")
    nested = attachments.groupBy(F.col("parent_url").alias("url")).agg(F.array_sort(F.collect_list(fields)).alias("a"))
    out = pages.join(nested, "url", "left")
    kind = "array<struct<name:string,extension:string,section:string,url:string,parent_url:string>>"
    plain = F.transform("a", lambda x: F.struct(x["name"].alias("name"), x["extension"].alias("extension"), x["section"].alias("section"), x["url"].alias("url"), x["parent_url"].alias("parent_url")))
    return out.withColumn("attachments", F.coalesce(plain, F.array().cast(kind))).drop("a")


def _filled(c: Column, *others: Column) -> Column:
    return F.coalesce(*(F.when(x != "", x) for x in (c, *others)), F.lit(""))


def _meta(rows: DataFrame, source_id: str) -> DataFrame:
    """The columns of a document from those that each kind of record fills."""
    title = _filled(clean_text("title"), clean_text("url"))
    out = rows.withColumns({"title": title, "source_id": F.lit(source_id), "url": clean_text("url")}).withColumn("canonical_title", canonical_title("title"))
    tags = unique_strings(F.concat("own_tags", "section_tags", F.array("facet", "record_type")), 16)
    none = lambda c: F.when(c != "", c)
    out = out.withColumns({
        "tags": tags, "nav_path_text": F.array_join("nav_path", " / "),
        "published_at": F.coalesce(normalize_iso_date("published_at"), none(clean_text("published_at"))), "updated_at": F.coalesce(normalize_iso_date("updated_at"), none(clean_text("updated_at"))), "recorded_at": none(clean_text("recorded_at")),
    })
    version = F.coalesce(normalize_iso_date("version_date"), infer_version_date(F.concat_ws(" ", "title", "summary", F.array_join("tags", " ")), F.col("published_at")))
    out = out.withColumn("version_date", version)
    kind = date_kind(F.col("published_at"), F.col("version_date"), F.col("recorded_at"))
    text = normalize_text(F.concat_ws(" ", "title", "section", F.array_join("nav_path", " "), F.array_join("tags", " "), "facet", "record_type"))
    about = F.concat_ws(" ", "title", "summary")
    out = out.withColumns({"date_kind": kind, "date_confidence": date_confidence(kind), "task_kind": infer_task_kind(F.col("source_id"), F.col("facet"), F.col("record_type"), text), "academic_year": infer_academic_year(about), "term": infer_term(about)})
    return out.withColumns({"authority_profile": authority_profile(F.col("source_id"), F.col("task_kind")), "dedupe_key": F.concat_ws(":", "source_id", "record_type", sha1_text(normalize_text("canonical_title"), 16)), "summary": clean_text("summary"), "attachment_count": F.size("attachments")})


COLUMNS = ["id", "record_type", "page_type", "facet", "title", "url", "source_id", "section_id", "section", "nav_path", "nav_path_text", "canonical_title", "published_at", "updated_at", "recorded_at", "version_date", "date_kind", "date_confidence", "academic_year", "term", "task_kind", "authority_profile", "dedupe_key", "publisher", "summary", "attachment_count", "hash", "tags", "outcome", "content", "attachments", "kind_no", "ordinal"]


def build_documents(package: dict[str, DataFrame], source_id: str, source_name: str) -> DataFrame:
    """Detail pages, attachments without a page, external links and the exam-query entry, as documents."""
    null = F.lit(None).cast("string")
    sections = sections_of(package["sections"])
    lists = last_of(package["list_pages"].withColumn("url", clean_text("url")), "url").select("url", clean_text("section_id").alias("section_id"))
    pages = package["detail_pages"].withColumns({"url": clean_text("url"), "section_id": clean_text("section_id")})
    files = attachments_of(package["attachments"])
    no_files = F.array().cast("array<struct<name:string,extension:string,section:string,url:string,parent_url:string>>")

    detail = with_section(pages, sections)
    title, content = _filled(clean_text("title"), F.col("url")), clean_text("content_text")
    page_id = _filled(clean_text("page_id"), sha1_text(F.col("url")))
    detail = detail.withColumns({"title": title, "content": F.when(content != "", content).otherwise(title), "summary": summarize(content, title), "id": F.concat(F.lit(f"{source_id}-detail-"), page_id)})
    facet_text = normalize_text(F.concat_ws(" ", "section", F.array_join("nav_path", " "), F.array_join("section_tags", " "), "title", "content"))
    detail = detail.withColumns({
        "record_type": F.lit("detail"), "facet": infer_facet(F.lit("detail"), facet_text), "page_type": _filled(clean_text("page_type"), F.lit("detail_article_page")), "hash": _filled(clean_text("content_hash"), sha1_text(F.col("content"))),
        "own_tags": F.transform(F.coalesce("headings", F.array().cast("array<string>")), clean_text), "outcome": F.lit("search_record"), "publisher": F.when(clean_text("publisher") != "", clean_text("publisher")), "recorded_at": null, "version_date": null, "kind_no": F.lit(0),
    })
    # an attachment's section is that of the first page of its parent url, its document the last one's
    first_page = first_of(pages.select("url", "section_id", "ordinal"), "url").select(F.col("url").alias("parent_url"), F.col("section_id").alias("page_section"), F.lit(True).alias("has_page"))
    placed = files.join(first_page, "parent_url", "left").join(lists.select(F.col("url").alias("parent_url"), F.col("section_id").alias("list_section")), "parent_url", "left")
    placed = placed.withColumn("section_id", F.when(F.col("has_page"), F.col("page_section")).otherwise(F.col("list_section")))
    placed = with_section(placed.drop("page_section", "list_section"), sections)
    detail = nested_attachments(detail, placed)

    orphan = placed.filter("has_page is null")
    own = F.array(F.struct("name", "extension", "section", "url", "parent_url")).cast(detail.schema["attachments"].dataType)
    orphan = orphan.withColumns({
        "id": F.concat(F.lit(f"{source_id}-attachment-"), F.col("attachment_id")), "title": F.col("name"), "summary": F.concat(F.lit("附件元数据："), "name", F.lit("。来源栏目："), "section", F.lit("。")), "record_type": F.lit("attachment"), "facet": F.lit("download"),
        "page_type": F.lit("attachment_metadata"), "hash": sha1_text(_filled(F.col("url"), F.col("name"))), "own_tags": F.array(F.col("extension"), F.lit("附件"), F.lit("下载")), "outcome": F.lit("attachment_metadata_only"), "publisher": null,
        "published_at": null, "updated_at": null, "recorded_at": null, "version_date": infer_version_date("name"), "attachments": own, "kind_no": F.lit(1),
    }).withColumn("content", F.col("summary"))

    links = package["external_links"].withColumns({"title": _filled(clean_text("label"), clean_text("url")), "url": clean_text("url"), "section_id": clean_text("source_section_id"), "category": _filled(clean_text("category"), F.lit("external_link"))})
    links = with_section(links, sections)
    external_id = _filled(clean_text("external_id"), sha1_text(F.concat("url", "title")))
    link_text = normalize_text(F.concat_ws(" ", "section", F.array_join("nav_path", " "), F.array_join("section_tags", " "), "title", "url", "category"))
    links = links.withColumns({
        "id": F.concat(F.lit(f"{source_id}-external-"), external_id), "summary": F.concat(F.lit(f"{source_name}记录的外链："), "title", F.lit("。该链接只记录入口，不递归抓取内容。")), "record_type": F.lit("external"), "facet": infer_facet(F.lit("external"), link_text, F.col("category")),
        "page_type": F.lit("external_link_record"), "hash": sha1_text(F.concat("url", "title")), "own_tags": F.array("category", doc_host("url"), "title"), "outcome": F.lit("external_record_only"), "publisher": null,
        "published_at": null, "updated_at": null, "version_date": infer_version_date("title"), "attachments": no_files, "kind_no": F.lit(2),
    }).withColumn("content", F.col("summary"))

    edges = package["edges"].withColumns({"title": clean_text("anchor_text"), "url": clean_text("to_url")}).filter("title = '考试信息查询'")
    edges = with_section(edges.join(lists, "url", "left"), sections)
    edge_id = _filled(clean_text("edge_id"), sha1_text(F.concat("url", "title")))
    edges = edges.withColumns({
        "id": F.concat(F.lit(f"{source_id}-utility-"), edge_id), "summary": F.lit(f"{source_name}首页记录的考试信息查询入口。"), "record_type": F.lit("utility"), "facet": F.lit("exam"), "page_type": F.lit("utility_link_record"), "hash": sha1_text(F.concat("url", "title")),
        "own_tags": F.array(*map(F.lit, ("考试", "查询", "入口"))), "outcome": F.lit("search_record"), "publisher": null, "published_at": null, "updated_at": null, "recorded_at": null, "version_date": null, "attachments": no_files, "kind_no": F.lit(3),
    }).withColumn("content", F.col("summary"))
    return reduce(DataFrame.unionByName, (_meta(rows, source_id).select(*COLUMNS) for rows in (detail, orphan, links, edges)))


def merge_packages(packages: list[DataFrame]) -> DataFrame:
    """Documents of all packages with a dense doc_index over packages, kinds and input order.

    Dense numbers come from counts of the blocks before and numbers within a block, so no task sorts all rows.
    """
    every = reduce(DataFrame.unionByName, (p.withColumn("package_no", F.lit(i)) for i, p in enumerate(packages)))
    return dense_index(every, ["package_no", "kind_no"], "ordinal").drop("package_no", "kind_no", "ordinal")


def dense_index(rows: DataFrame, group: list[str], ordinal: str, name: str = "doc_index", size: int = 1 << 20) -> DataFrame:
    """0, 1, ... over group columns, then ordinal. Ordinals are cut into ranges of `size`."""
    cut = rows.withColumn("_cut", F.floor(F.col(ordinal) / size))
    counts = cut.groupBy(*group, "_cut").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy(*group, "_cut")) - F.col("_n")  # one row per range
    starts = counts.withColumn("_start", before).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, "_cut").orderBy(ordinal))
    return cut.join(starts, [*group, "_cut"]).withColumn(name, (F.col("_start") + inside - 1).cast("long")).drop("_cut", "_start")


def source_manifests(sources: DataFrame, documents: DataFrame, **parts: DataFrame) -> DataFrame:
    """source_id with its documents, shards and bytes, and n_<part> of each further table that has source_id.

    Each table is counted by source before the join, so what meets is one row a source; a source without rows
    has 0, and rows of no listed source are left out."""
    own = documents.groupBy("source_id").agg(F.count(F.lit(1)).alias("n_documents"), F.countDistinct("shard_id").alias("n_shards"), F.sum(F.octet_length("content")).alias("bytes"))
    out = sources.select("source_id").distinct().join(own, "source_id", "left")
    for name, rows in parts.items():
        out = out.join(rows.groupBy("source_id").agg(F.count(F.lit(1)).alias(f"n_{name}")), "source_id", "left")
    return out.na.fill(0, ["n_documents", "n_shards", "bytes", *(f"n_{name}" for name in parts)])


def external_index(documents: DataFrame) -> DataFrame:
    return documents.filter("record_type = 'external'").select("id", "title", "url", "outcome")


def outcomes(documents: DataFrame) -> DataFrame:
    """url, document_id, outcome and kind of every document."""
    return documents.select("url", F.col("id").alias("document_id"), "outcome", F.col("record_type").alias("kind"))


LOCAL_FIELDS = [c for c in COLUMNS if c not in ("content", "summary", "attachments", "hash", "kind_no", "ordinal")]


def local_metadata(documents: DataFrame) -> DataFrame:
    """What a light index carries of a document: no content, summary or attachments."""
    return documents.select("doc_index", *LOCAL_FIELDS, *(c for c in ("shard_id",) if c in documents.columns))


def attachment_names(attachments: DataFrame) -> DataFrame:
    return attachments.select("attachment_id", "name", "extension", "parent_url", normalize_text("name").alias("normalized_name"))


def section_counts(sections: DataFrame, documents: DataFrame) -> DataFrame:
    """Sections with their number of documents, 0 included, by source and section."""
    counts = documents.groupBy("source_id", "section_id").agg(F.count(F.lit(1)).alias("documents"))
    return sections.join(counts, ["source_id", "section_id"], "left").withColumn("documents", F.coalesce("documents", F.lit(0)))
