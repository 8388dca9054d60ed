"""Rendering, packing and reports of communities.

Edges are those of traverse.ranked_edges(), members without edges those of traverse.isolated().
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import CHARS_PER_TOKEN
from tessella.operators.extraction import Prompts, fill, unfenced

REPORT = "struct<title:string,summary:string,rating:string,rating_explanation:string,findings:array<struct<description:string,rank:double,references:array<struct<target_id:string,target_type:string>>>>>"
REFERENCE_TYPES = ("entity", "relationship", "claim")


def _line(type: Column, name: Column, description: Column) -> Column:
    return F.concat(F.lit("- ["), type, F.lit("] "), name, F.lit(": "), description)


def render(edges: DataFrame, lone: DataFrame, entities: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """community_id, level, text: entities in full where an edge first names them, edges by rank, then isolated members
    by id, then claims of the members (community_id, level, id, claim_type, description)."""
    by = ["community_id", "level"]
    ends = None
    for slot, p in enumerate(("source", "target")):
        x = edges.select(*by, F.struct("rank", F.lit(slot).alias("slot")).alias("at"), F.col(f"{p}_id").alias("id"), _line(F.col(f"{p}_type"), F.col(f"{p}_name"), F.col(f"{p}_description")).alias("line"))
        ends = x if ends is None else ends.unionByName(x)
    named = ends.groupBy(*by, "id").agg(F.min_by("line", "at").alias("line"), F.min("at").alias("at"))
    row = lambda part, rank, slot, id, line: [*by, F.struct(F.lit(part).alias("part"), rank.cast("bigint").alias("rank"), F.lit(slot).alias("slot") if isinstance(slot, int) else slot.alias("slot"), id.cast("string").alias("id")).alias("at"), line.alias("line")]
    none = F.lit("")
    lines = named.select(*row(0, F.col("at.rank"), F.col("at.slot"), none, F.col("line")))
    lines = lines.unionByName(edges.select(*row(0, F.col("rank"), 2, none, F.concat(F.lit("  "), "source_name", F.lit(" --["), "type", F.lit("]--> "), "target_name"))))
    own = lone.join(entities.select(F.col("id").alias("entity_id"), F.coalesce("name", "id").alias("name"), F.coalesce("description", F.lit("")).alias("description"), "type"), "entity_id")
    lines = lines.unionByName(own.select(*row(1, F.lit(0), 0, F.col("entity_id"), _line(F.col("type"), F.col("name"), F.col("description")))))
    if claims is not None:
        c = claims.select(*row(3, F.lit(0), 0, F.col("id"), F.concat(F.lit("  ["), "id", F.lit("] ("), "claim_type", F.lit(") "), "description")))
        head = claims.select(*by).distinct().select(*row(2, F.lit(0), 0, none, F.lit("\nClaims:")))
        lines = lines.unionByName(head).unionByName(c)
    return lines.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))


PACKED = "community_id string, level int, text string, used_tokens int, included_edges int, excluded_edges int, included_entities int, excluded_entities int, truncated boolean"


def pack(edges: DataFrame, lone: DataFrame, entities: DataFrame, max_tokens: int, ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """Contexts within a budget: edges by rank, each with its ends where they are new, then isolated members; what doesn't
    fit is skipped, and later ones are tried. That is a fold in order, one task a community."""
    count = lambda t: math.ceil(len(t) / ratio)
    ends = [f"{p}_{c}" for p in ("source", "target") for c in ("id", "name", "description", "type")]
    rows = edges.select("community_id", "level", F.col("rank").cast("bigint").alias("rank"), "type", *ends)
    own = lone.join(entities.select(F.col("id").alias("entity_id"), F.coalesce("name", "id").alias("name"), F.coalesce("description", F.lit("")).alias("description"), F.col("type").alias("kind")), "entity_id")
    alone = own.select("community_id", "level", F.col("entity_id").alias("source_id"), F.col("name").alias("source_name"), F.col("description").alias("source_description"), F.col("kind").alias("source_type"))
    rows = rows.unionByName(alone, allowMissingColumns=True)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        linked = pdf[pdf["rank"].notna()].sort_values("rank")
        rest = pdf[pdf["rank"].isna()].sort_values("source_id")
        lines, seen, every = [], set(), set()
        used = edges_in = edges_out = alone_in = 0
        cut_off = False
        for e in linked.to_dict("records"):
            unit, ids = [], {e["source_id"], e["target_id"]}
            every |= ids
            new = set()
            for p in ("source", "target"):
                if e[f"{p}_id"] not in seen | new:
                    unit.append(f"- [{e[f'{p}_type']}] {e[f'{p}_name']}: {e[f'{p}_description']}")
                    new.add(e[f"{p}_id"])
            unit.append(f"  {e['source_name']} --[{e['type']}]--> {e['target_name']}")
            text = "\n".join(unit)
            if max_tokens > 0 and used + count(text) <= max_tokens:
                lines.append(text)
                used += count(text)
                seen |= ids
                edges_in += 1
            else:
                edges_out += 1
                cut_off = max_tokens > 0
        for e in rest.to_dict("records"):
            every.add(e["source_id"])
            if e["source_id"] in seen:
                continue
            text = f"- [{e['source_type']}] {e['source_name']}: {e['source_description']}"
            if max_tokens > 0 and used + count(text) <= max_tokens:
                lines.append(text)
                used += count(text)
                seen.add(e["source_id"])
                alone_in += 1
            else:
                cut_off = max_tokens > 0
        at = pdf.iloc[0]
        return pd.DataFrame([(at["community_id"], at["level"], "\n".join(lines), used, edges_in, edges_out, alone_in, len(every) - len(seen), cut_off)], columns=[c.split()[0] for c in PACKED.split(", ")])

    return rows.groupBy("community_id", "level").applyInPandas(fold, PACKED)


def pack_items(items: DataFrame, budget: int, by: str, order: str, tokens: str, text: str | None = None, ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """items with `included`: in order (ties by the other columns), each that still fits the budget of its group; a fold in the JVM.

    With a text column, one that doesn't fit is cut to what is left of the budget, if anything is, and counts in `truncated`;
    its tokens are then those of the cut text.
    """
    if budget < 0:
        raise ValueError("the budget is 0 at least")
    rest = [c for c in items.columns if c not in (by, order, tokens)]
    if text is not None:
        return _pack_texts(items, budget, by, order, tokens, text, ratio)
    each = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(tokens), *rest)))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<boolean>").alias("keep"))

    def step(acc: Column, x: Column) -> Column:
        n = x[tokens].cast("bigint")
        fits = acc["used"] + n <= budget
        return F.struct((acc["used"] + F.when(fits, n).otherwise(0)).alias("used"), F.concat(acc["keep"], F.array(fits)).alias("keep"))

    kept = items.groupBy(by).agg(each.alias("x")).select(by, "x", F.aggregate("x", start, step)["keep"].alias("k"))
    return kept.select(by, F.explode(F.arrays_zip("x", "k")).alias("z")).select(by, "z.x.*", F.col("z.k").alias("included"))


def _pack_texts(items: DataFrame, budget: int, by: str, order: str, tokens: str, text: str, ratio: float) -> DataFrame:
    rest = [c for c in items.columns if c not in (by, order, tokens, text)]
    each = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(tokens).cast("bigint").alias(tokens), F.col(text), *rest)))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<bigint>").alias("given"))

    def step(acc: Column, x: Column) -> Column:
        left = budget - acc["used"]
        # What is cut takes all that is left, or what its characters make.
        given = F.when(x[tokens] <= left, x[tokens]).otherwise(F.least(left, F.ceil(F.length(x[text]) / F.lit(float(ratio)))))
        return F.struct((acc["used"] + given).alias("used"), F.concat(acc["given"], F.array(given)).alias("given"))

    kept = items.groupBy(by).agg(each.alias("_x")).select(by, "_x", F.aggregate("_x", start, step)["given"].alias("_y"))
    z = kept.select(by, F.explode(F.arrays_zip("_x", "_y")).alias("_z")).select(by, "_z._x.*", F.col("_z._y").alias("_g"))
    whole = F.col("_g") >= F.col(tokens)
    return z.select(by, order, F.when(whole, F.col(tokens)).otherwise(F.col("_g")).alias(tokens), F.when(whole, F.col(text)).otherwise(F.substring(F.col(text), F.lit(1), F.floor(F.col("_g") * ratio).cast("int"))).alias(text), *rest, (whole | (F.col("_g") > 0)).alias("included"), (~whole & (F.col("_g") > 0)).alias("truncated"))


def reference_ids(edges: DataFrame, lone: DataFrame, claims: DataFrame | None = None) -> DataFrame:
    """community_id, level, ids: what a report may refer to, entities, edges (source:TYPE:target), claims."""
    by = ["community_id", "level"]
    x = edges.select(*by, F.explode(F.expr("array(named_struct('p', 0, 'id', source_id), named_struct('p', 0, 'id', target_id), named_struct('p', 1, 'id', source_id || ':' || type || ':' || target_id))")).alias("r"))
    x = x.unionByName(lone.select(*by, F.struct(F.lit(0).alias("p"), F.col("entity_id").alias("id")).alias("r")))
    if claims is not None:
        x = x.unionByName(claims.select(*by, F.struct(F.lit(2).alias("p"), F.col("id")).alias("r")))
    return x.groupBy(*by).agg(F.transform(F.array_sort(F.collect_set("r")), lambda r: r["id"]).alias("ids"))


def report_prompt(community: Column, level: Column, context: Column, ids: Column, prompts: Prompts = Prompts()) -> Column:
    return fill(prompts.report, community=community, level=level.cast("string"), context=context, ids=F.array_join(ids, "\n"))


def repair_prompt(problems: Column, content: Column, ids: Column, prompts: Prompts = Prompts()) -> Column:
    return fill(prompts.repair, problems=problems, content=content, ids=F.array_join(ids, "\n"))


def report_problems(content: Column, ids: Column) -> Column:
    """What keeps an answer from being a report, in words; empty for one that is."""
    x = F.from_json(unfenced(content), REPORT)
    missing = lambda c: F.coalesce(x[c], F.lit("")) == ""
    allowed = F.exists(F.coalesce(F.flatten(F.transform(x["findings"], lambda f: F.when(f["description"] != "", f["references"]))), F.array()), lambda r: r["target_type"].isin(*REFERENCE_TYPES) & F.array_contains(ids, r["target_id"]))
    said = F.array(
        F.when(missing("title") & missing("summary") & x["findings"].isNull(), "it isn't a JSON object of the form asked for"), F.when(missing("title"), "it has no title"), F.when(missing("summary"), "it has no summary"),
        F.when(x["rating"].try_cast("double").isNull(), "its rating isn't a number"), F.when(~F.coalesce(allowed, F.lit(False)), "no finding has a description and a reference to one of the ids"),
    )
    return F.array_join(F.filter(said, lambda s: s.isNotNull()), "; ")


def parse_report(content: Column, ids: Column, community: Column, level: Column) -> Column:
    """A report of a model's answer, or null: it needs a title, a summary, a numeric rating and findings; references that
    aren't allowed go, and findings without one."""
    x = F.from_json(unfenced(content), REPORT)
    none = F.from_json(F.lit('{"findings":[]}'), REPORT)["findings"]
    ok = lambda r: r["target_type"].isin(*REFERENCE_TYPES) & F.array_contains(ids, r["target_id"])
    slim = F.transform(F.coalesce(x["findings"], none), lambda f: F.struct(f["description"].alias("description"), F.coalesce(f["rank"], F.lit(0.0)).alias("rank"), F.coalesce(F.filter(f["references"], ok), F.from_json(F.lit("[]"), "array<struct<target_id:string,target_type:string>>")).alias("references")))
    good = F.filter(slim, lambda f: (F.size(f["references"]) > 0) & (f["description"] != ""))
    findings = F.transform(good, lambda f, i: F.struct(F.concat(F.lit("finding:"), i.cast("string")).alias("id"), f["description"].alias("description"), f["rank"].alias("rank"), f["references"].alias("references")))
    rating = x["rating"].try_cast("double")
    made = F.struct(F.concat_ws(":", F.lit("report"), community, level.cast("string")).alias("id"), x["title"].alias("title"), x["summary"].alias("summary"), rating.alias("rating"), F.coalesce(x["rating_explanation"], F.lit("")).alias("rating_explanation"), findings.alias("findings"))
    return F.when((x["title"] != "") & (x["summary"] != "") & rating.isNotNull() & (F.size(findings) > 0), made)


def report_text(report: Column) -> Column:
    """Title, summary, and findings by falling rank, then id, each with its references."""
    refs = lambda f: F.array_join(F.transform(f["references"], lambda r: F.concat(r["target_type"], F.lit(":"), r["target_id"])), ", ")
    order = F.array_sort(F.transform(report["findings"], lambda f: F.struct((-f["rank"]).alias("r"), f["id"].alias("id"), F.concat(F.lit("- "), f["description"], F.lit(" [refs: "), refs(f), F.lit("]")).alias("line"))))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), report["title"]), report["summary"], F.array_join(F.transform(order, lambda x: x["line"]), "\n"))


def report_json(report: Column) -> Column:
    """JSON of a report, keys in order, nulls left out; null for none."""
    by_name = F.struct(
        F.transform(report["findings"], lambda f: F.struct(f["description"].alias("description"), f["id"].alias("id"), f["rank"].alias("rank"), F.transform(f["references"], lambda r: F.struct(r["target_id"].alias("target_id"), r["target_type"].alias("target_type"))).alias("references"))).alias("findings"),
        *[report[c].alias(c) for c in ("id", "rating", "rating_explanation", "summary", "title")],
    )
    return F.when(report.isNotNull(), F.to_json(by_name))


def child_context(children: DataFrame, max_tokens: int | None = None, ratio: float = CHARS_PER_TOKEN) -> DataFrame:
    """community_id, level, text of traverse.community_children(): the children's summaries by id, each under its name,
    parted by blank lines; with a budget those that fit it in that order, the first that doesn't cut to what is left."""
    head = F.concat(F.lit("Community "), "child_id", F.lit(" (level "), F.col("level").cast("string"), F.lit("):\n"), "summary")
    x = children.select(F.struct(F.col("parent_id").alias("id"), F.col("parent_level").alias("level")).alias("at"), "child_id", head.alias("text"))
    if max_tokens is not None:
        x = pack_items(x.withColumn("n", F.ceil(F.length("text") / F.lit(float(ratio)))), max_tokens, "at", "child_id", "n", "text", ratio).filter("included")
    return x.groupBy("at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("child_id", "text"))), lambda x: x["text"]), "\n\n").alias("text")).select(F.col("at.id").alias("community_id"), F.col("at.level").alias("level"), "text")


def json_references(report_json_: Column) -> Column:
    """References of a report's JSON; null if it isn't an object."""
    x = F.from_json(report_json_, REPORT)
    refs = F.flatten(F.transform(F.filter(x["findings"], lambda f: f["references"].isNotNull()), lambda f: f["references"]))
    trimmed = F.transform(refs, lambda r: F.struct(F.trim(r["target_type"]).alias("target_type"), F.trim(r["target_id"]).alias("target_id")))
    return F.filter(trimmed, lambda r: r["target_type"].isin(*REFERENCE_TYPES) & (r["target_id"] != ""))


def text_references(text: Column) -> Column:
    """References of the [refs: type:id, ...] parts of a report's text."""
    entries = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\[refs:\s*([^\]]+)\]"), F.lit(1)), lambda m: F.split(m, ",")))
    with_colon = F.filter(F.transform(entries, lambda e: F.trim(e)), lambda e: e.contains(":"))
    pairs = F.transform(with_colon, lambda e: F.struct(F.trim(F.substring_index(e, ":", 1)).alias("target_type"), F.trim(F.substring(e, F.instr(e, F.lit(":")) + 1, F.length(e))).alias("target_id")))
    return F.filter(pairs, lambda r: r["target_type"].isin(*REFERENCE_TYPES) & (r["target_id"] != ""))


def first_places(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
