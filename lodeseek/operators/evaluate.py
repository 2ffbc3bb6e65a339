"""Evaluation of retrieval against a manifest. [E6-E8, F14-F17, G14-G20, H8, P]

Evidence rows carry (case_id, mode, rank, ...). All metrics are aggregations over tables of cases; a planner sweep
retrieves once and merges once for each variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeseek.operators.filters import first_rows
from lodeseek.session import settled as written

CASE = "case_id string, query string, expected_terms array<string>, expected_pages array<int>"


def tiers(documents: DataFrame, manifest: dict[str, str] | None = None) -> DataFrame:
    """document_id, tier: the manifest's, else the first of three metadata keys, else unlabeled. [F14]

    documents has document_id and metadata (map<string,string>).
    """
    given = manifest or {}
    named = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])[F.col("document_id")] if given else F.lit(None).cast("string")
    meta = [F.try_element_at(F.col("metadata"), F.lit(k)) for k in ("source_quality_tier", "quality_tier", "ocr_quality_tier")]
    return documents.select("document_id", F.coalesce(named, *meta, F.lit("unlabeled")).alias("tier"))


def holds_all(terms: Column, text: Column) -> Column:
    """Every term is part of the text, without case; no terms, no match. [E6]"""
    return F.coalesce((F.size(terms) > 0) & F.forall(terms, lambda t: F.contains(F.lower(text), F.lower(t))), F.lit(False))


def on_page(pages: Column, seen: Column) -> Column:
    """[E7]"""
    return F.coalesce((F.size(pages) > 0) & F.arrays_overlap(pages, seen), F.lit(False))


def case_metrics(cases: DataFrame, evidence: DataFrame, cards: DataFrame, keys: tuple[str, ...] = ("mode",)) -> DataFrame:
    """One row for each case and mode: term_hit, page_hit, citation_supported, answerable, confidence, reciprocal_rank.

    evidence has case_id, keys, rank, text, page_numbers; cards has case_id, keys, answerable, supported, confidence.
    """
    by = ["case_id", *keys]
    rows = evidence.join(cases, "case_id")
    fits = holds_all(F.col("expected_terms"), F.col("text")) | on_page(F.col("expected_pages"), F.col("page_numbers"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n")
    got = rows.groupBy(*by).agg(whole.alias("all_text"), F.array_distinct(F.flatten(F.collect_list("page_numbers"))).alias("pages"), F.min(F.when(fits, F.col("rank"))).alias("first"))
    out = cards.join(cases, "case_id").join(got, by, "left")
    return out.select(
        *by, holds_all(F.col("expected_terms"), F.coalesce("all_text", F.lit(""))).alias("term_hit"), on_page(F.col("expected_pages"), F.coalesce("pages", F.array().cast("array<int>"))).alias("page_hit"), F.col("supported").alias("citation_supported"),
        "answerable", "confidence", F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def mode_metrics(metrics: DataFrame, keys: tuple[str, ...] = ("mode",)) -> DataFrame:
    """Rates, mean confidence and mean reciprocal rank of each mode. [G14]"""
    rate = lambda c, name: F.round(F.avg(F.col(c).cast("double")), 9).alias(name)
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("cases"), rate("term_hit", "term_hit_rate"), rate("page_hit", "page_hit_rate"), rate("citation_supported", "citation_support_rate"), rate("answerable", "answerable_rate"), rate("confidence", "average_confidence"), rate("reciprocal_rank", "mrr"),
    )


def planner_against_static(modes: DataFrame, columns: tuple[str, ...] = ("term_hit_rate", "page_hit_rate", "citation_support_rate", "answerable_rate", "mrr", "average_confidence")) -> DataFrame:
    """metric, planner, static_mean (unweighted), delta, wins and losses (modes it beats, or that beat it). [G15]"""
    long = modes.select("mode", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))
    plan = long.where("mode = 'planner'").select("metric", F.col("value").alias("planner"))
    rest = long.where("mode <> 'planner'").join(plan, "metric")
    listed = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("mode"))))
    out = rest.groupBy("metric", "planner").agg(F.round(F.avg("value"), 9).alias("static_mean"), listed(F.col("planner") > F.col("value")).alias("wins"), listed(F.col("planner") < F.col("value")).alias("losses"))
    return out.withColumn("delta", F.round(F.col("planner") - F.col("static_mean"), 9))


def sweep_best(metrics: DataFrame) -> DataFrame:
    """The variants that lead by reciprocal rank and by confidence; the first of equals. [G16] metrics: ordinal, variant, mrr, average_confidence."""
    lead = lambda c: F.max_by("variant", F.struct(F.col(c), -F.col("ordinal")))
    return metrics.agg(lead("mrr").alias("best_by_mrr"), lead("average_confidence").alias("best_by_confidence"))


def tier_rollup(facts: DataFrame) -> DataFrame:
    """tier (null: all), documents, chunks, entities, references: totals and distinct names, per tier and overall. [G19]

    facts: document_id, tier, kind ("chunk", "entity", "reference"), name.
    """
    count = lambda kind: F.count_distinct(F.when(F.col("kind") == kind, F.col("name"))).alias(f"distinct_{kind}")
    return facts.rollup("tier").agg(F.count_distinct("document_id").alias("documents"), count("chunk"), count("entity"), count("reference"), F.count_if(F.col("kind") == "entity").alias("entity_mentions"), F.count_if(F.col("kind") == "reference").alias("reference_mentions"))


def recall(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """kind, expected, found, recall, missing: expected names among the observed, without case. [F17] Both: kind, name."""
    want = expected.select("kind", F.col("name"), F.lower("name").alias("key")).distinct()
    have = observed.select("kind", F.lower("name").alias("key")).distinct().withColumn("seen", F.lit(True))
    rows = want.join(have, ["kind", "key"], "left")
    return rows.groupBy("kind").agg(F.count("*").alias("expected"), F.count_if("seen").alias("found"), F.round(F.count_if("seen") / F.count("*"), 9).alias("recall"), F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.col("name")))).alias("missing"))


def recall_by_tier(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """tier (null: all documents), kind, expected, found, recall, missing. expected: tier, kind, name; observed: tier, kind, name. [F17, G20]

    A name that is expected of a tier must be seen in that tier; one that is expected of all, anywhere.
    """
    want = expected.select("tier", "kind", "name", F.lower("name").alias("key")).distinct()
    have = observed.select(F.explode(F.array("tier", F.lit(None).cast("string"))).alias("t"), F.col("kind").alias("k"), F.lower("name").alias("n")).distinct().withColumn("seen", F.lit(True))
    rows = want.join(have, F.col("tier").eqNullSafe(F.col("t")) & (F.col("kind") == F.col("k")) & (F.col("key") == F.col("n")), "left")
    return rows.groupBy("tier", "kind").agg(F.count("*").alias("expected"), F.count_if(F.coalesce("seen", F.lit(False))).alias("found"), F.round(F.count_if(F.coalesce("seen", F.lit(False))) / F.count("*"), 9).alias("recall"), F.array_sort(F.collect_list(F.when(F.col("seen").isNull(), F.col("name")))).alias("missing"))


SIZES = {"nodes": "chunk", "sections": "section", "entities": "entity", "references": "reference"}


def extraction_by_tier(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """tier (null: all), documents, the totals of SIZES and edges over documents, their averages (average_...), relations (map). [G19, P4]

    facts: rows of extraction_facts; relations: document_id, tier, relation, n.
    """
    per = facts.groupBy("document_id", "tier").agg(*[F.count_distinct(F.when(F.col("kind") == kind, F.col("name"))).alias(name) for name, kind in SIZES.items()])
    per = per.join(relations.groupBy("document_id").agg(F.sum("n").alias("edges")), "document_id", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("long")))
    names = [*SIZES, "edges"]
    sums = per.rollup("tier").agg(F.count("*").alias("documents"), *[F.sum(c).alias(c) for c in names], *[F.round(F.avg(c), 9).alias(f"average_{c}") for c in names])
    said = relations.select(F.explode(F.array("tier", F.lit(None).cast("string"))).alias("of"), "relation", "n").groupBy("of", "relation").agg(F.sum("n").alias("n"))
    said = said.groupBy("of").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", "n")))).alias("relations"))
    return sums.join(said, F.col("tier").eqNullSafe(F.col("of")), "left").drop("of")


def expected_by_tier(manifest: dict) -> list[dict]:
    """kind, tier (null: all), values: the distinct values that a manifest and its queries expect. [G20]"""
    out = []
    parts = [manifest, *manifest.get("queries", [])]
    for kind in ("entities", "references", "sections"):
        every = {str(v) for p in parts for v in p.get(f"expected_{kind}") or ()}
        by: dict[str, set] = {}
        for p in parts:
            for tier, values in (p.get(f"expected_{kind}_by_tier") or {}).items():
                by.setdefault(str(tier), set()).update(map(str, values))
        out += [{"kind": kind, "tier": t, "values": sorted(v)} for t, v in [(None, every), *sorted(by.items())] if v]
    return out


def extraction_facts(nodes: DataFrame, tier_of: DataFrame) -> DataFrame:
    """document_id, tier, kind, name: what was found in the chunks. nodes: rows of graph.nodes; tier_of: document_id, tier."""
    named = lambda kind, names: F.transform(names, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    rows = nodes.select("document_id", F.inline(F.concat(named("chunk", F.array("chunk_id")), named("entity", F.col("entities")), named("reference", F.col("references")), named("section", F.filter(F.array("section"), lambda x: x.isNotNull() & (x != ""))))))
    return rows.join(tier_of, "document_id", "left").select("document_id", F.coalesce("tier", F.lit("unlabeled")).alias("tier"), "kind", "name")


def graph_diagnostics(evidence: DataFrame, relations: DataFrame, chunks: DataFrame) -> dict:
    """Over the cases with graph evidence: mean seeds and expanded rows, relations of the rows, and the graph's size. [G17, G21]

    relations: rows of graph.relation_counts over the same chunks.
    """
    rows = evidence.where(F.contains("retrieval_path", F.lit("graph"))).select("case_id", "mode", F.split(F.try_element_at("metadata", F.lit("relations")), ",").alias("r"))
    case = rows.groupBy("case_id", "mode").agg(F.count_if(F.array_contains("r", "seed")).alias("seeds"), F.count_if(~F.array_contains("r", "seed")).alias("expanded"))
    means = case.agg(F.count("*").alias("cases"), F.round(F.avg("seeds"), 9).alias("seeds"), F.round(F.avg("expanded"), 9).alias("expanded")).first()
    seen = {r["x"]: r["count"] for r in rows.select(F.explode("r").alias("x")).where("x <> 'seed'").groupBy("x").count().orderBy(F.desc("count"), "x").collect()}
    size = chunks.agg(F.count("*").alias("n"), F.count_distinct("document_id").alias("d")).first()
    built = {r["relation"]: r["n"] for r in relations.groupBy("relation").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "relation").collect()}
    shown = [r.asDict() for r in first_rows(case.withColumn("n", F.col("case_id").cast("int")), "n", "case_id", "mode").drop("n").collect()]  # [I8]
    return {"rows": shown, "cases": means["cases"], "average_seeds": means["seeds"] or 0.0, "average_expanded": means["expanded"] or 0.0, "nodes": size["n"], "edges": sum(built.values()), "documents": size["d"], "relations": built, "relations_in_evidence": seen}


def visual_diagnostics(evidence: DataFrame, cases: int) -> dict:
    """How many cases have page evidence, by itself and through the planner, and the planner's share. [G18]"""
    rows = evidence.where(F.contains("retrieval_path", F.lit("visual")))
    planned = F.col("mode") == "planner"
    got = rows.agg(F.count("*").alias("rows"), F.count_distinct(F.when(~planned, F.col("case_id"))).alias("visual"), F.count_distinct(F.when(planned, F.col("case_id"))).alias("planner")).first()
    return {"evidence_rows": got["rows"], "visual_cases": got["visual"], "planner_visual_cases": got["planner"], "planner_contribution_rate": round(got["planner"] / cases, 9) if cases else 0.0}


def sweep_variants(given, bonus: float = 0.08, weight: float = 0.10) -> list[dict]:
    """Variants of a manifest's planner_sweep: none, both strategies with and without rerank (true), or a list. [P2]"""
    from lodeseek.plans.planner import check_strategy

    if not given:
        return []
    asked = [{"merge_strategy": s, "rerank": r} for s in ("score_max", "route_vote") for r in (False, True)] if given is True else given
    out = []
    for v in asked:
        one = {"merge_strategy": v.get("merge_strategy", "score_max"), "rerank": boolean(v.get("rerank", False)), "route_vote_bonus": float(v.get("route_vote_bonus", bonus)), "rerank_overlap_weight": float(v.get("rerank_overlap_weight", weight))}
        check_strategy(one["merge_strategy"])
        one["name"] = v.get("name") or one["merge_strategy"] + ("_rerank" if one["rerank"] else "")
        out.append(one)
    return out


def boolean(value) -> bool:
    return value.strip().lower() in {"1", "true", "yes", "on"} if isinstance(value, str) else bool(value)


def load_manifest(path: str) -> dict:
    """[A12]"""
    import json

    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise ValueError(f"Could not read manifest {path}: {e}") from e
    if not isinstance(found, dict):
        raise ValueError(f"Could not read manifest {path}: not an object")
    return found


def settled(df: DataFrame) -> DataFrame:
    """Rows that are bounded by the manifest, which is on the driver anyway: later steps read them, not their plan."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


PARAMETERS = {"strategy": "planner_merge_strategy", "rerank": "planner_rerank", "vote_bonus": "planner_route_vote_bonus", "overlap_weight": "planner_rerank_overlap_weight"}


def parameters(given: dict, defaults: dict) -> dict:
    """The planner's parameters of a manifest or a case; what it does not name is as in defaults. [F15]"""
    from lodeseek.plans.planner import check_strategy

    out = {name: type(defaults[name])(given[key]) if key in given and name != "rerank" else boolean(given.get(key, defaults[name])) if name == "rerank" else defaults[name] for name, key in PARAMETERS.items()}
    check_strategy(out["strategy"])
    return out


def scope_of(case: dict, manifest: dict) -> tuple[str, ...]:
    """The documents of a case: its own document, the manifest's, its own list, the manifest's list; an error without any. [F15]"""
    one = case.get("document_id") or manifest.get("document_id")
    found = (one,) if one else tuple(case.get("document_ids") or manifest.get("document_ids") or ())
    if not found:
        raise ValueError("Each case needs document_id or document_ids, or the manifest must have them")
    return found


class Stored:
    """What evaluation reads of a store: indexes(documents), lacking(names, documents), vectors(question) and the settings that made them."""

    def __init__(self, indexes, lacking, vectors=None, **made):
        self.indexes, self.lacking, self.vectors, self.made = indexes, lacking, vectors, made


def swept(hits: DataFrame, variants: list[dict], cases: DataFrame, k: int) -> DataFrame:
    """mode_metrics with ordinal, of each variant, in one plan: variants are rows of the questions. [F16, P3]

    hits: of all cases, found once; cases: CASE.
    """
    from lodeseek.operators import evidence as M
    from lodeseek.operators import merge

    row = lambda n, v: F.struct(F.lit(n).alias("ordinal"), F.lit(v["merge_strategy"]).alias("strategy"), F.lit(v["rerank"]).alias("rerank"), F.lit(v["route_vote_bonus"]).alias("vote_bonus"), F.lit(v["rerank_overlap_weight"]).alias("overlap_weight"))
    asked = cases.select("case_id", F.col("query").alias("question"), F.inline(F.array(*[row(n, v) for n, v in enumerate(variants)])))
    asked = asked.withColumn("query_id", F.concat(F.col("ordinal").cast("string"), F.lit(":"), F.col("case_id")))
    each = hits.withColumnRenamed("query_id", "case_id").join(asked.select("query_id", "case_id"), "case_id").drop("case_id")
    found = written(merge.merged(each, asked, k))  # at most k rows a question
    cards = M.cards(found, asked)
    cards = cards.join(M.supported(cards), "query_id").select("query_id", "answerable", "supported", "confidence")
    part = lambda df: df.join(asked.select("query_id", "case_id", "ordinal"), "query_id").drop("query_id")
    return mode_metrics(case_metrics(cases, part(found), part(cards), ("ordinal",)), ("ordinal",))


def run(spark, manifest: dict, chunks: DataFrame, pages: DataFrame, k: int = 5, modes: tuple[str, ...] = ("bm25", "dense", "hybrid", "planner"), stored: Stored | None = None, defaults: dict | None = None) -> dict:
    """A report over a manifest's queries: per-mode metrics, planner against the others, and its sweep. [P1, P3]

    All cases of one scope are one batch. With stored, every mode reads the store's indexes by its settings, as a
    query does; an index that documents lack leaves its mode or route without hits there, and the report names it
    (missing_indexes). Without it, rows are made from chunks and pages.
    """
    from lodeseek.operators import evidence as M
    from lodeseek.operators import graph, merge
    from lodeseek.operators import retrievers as R
    from lodeseek.plans import retrieve

    for m in modes:
        retrieve.check_mode(m)
    plan = parameters(manifest, defaults or {"strategy": "score_max", "rerank": True, "vote_bonus": 0.08, "overlap_weight": 0.10})
    cases, own, by_scope = [], {}, {}
    for i, q in enumerate(manifest.get("queries", [])):
        cases.append((str(i), q["query"], q.get("expected_terms", []), q.get("expected_pages", [])))
        own[str(i)] = parameters(q, plan)
        by_scope.setdefault(scope_of(q, manifest), []).append((str(i), q["query"]))
    table = spark.createDataFrame(cases, CASE)
    evidence = cards = hits = None
    variants = sweep_variants(manifest.get("planner_sweep"), plan["vote_bonus"], plan["overlap_weight"])
    add = lambda a, b: b if a is None else a.unionByName(b)
    report: dict = {"missing_indexes": []}
    made = stored.made if stored else {}
    for scope, rows in by_scope.items():
        questions = spark.createDataFrame([(*r, *(own[r[0]][c] for c in PARAMETERS)) for r in rows], "query_id string, question string, strategy string, rerank boolean, vote_bonus double, overlap_weight double")
        plain = questions.select("query_id", "question")
        here = chunks.where(F.col("document_id").isin(*scope)), pages.where(F.col("document_id").isin(*scope))
        indexes = stored.indexes(list(scope)) if stored else None
        vectors = [(i, v) for i, q in rows if (v := stored.vectors(q))] if stored and stored.vectors else []
        asked = {"question_vectors": spark.createDataFrame(vectors, "query_id string, vectors array<array<double>>")} if vectors else {}
        planned = None
        if variants or "planner" in modes:
            planned = settled(retrieve.planner_hits(*here, plain, k, "document", indexes=indexes, **made, **asked))  # once for the mode and all variants
            hits = add(hits, planned)
        for m in modes:
            e = settled(merge.merged(planned, questions, k).select(*R.EVIDENCE) if m == "planner" else retrieve.retrieve(m, *here, plain, k, indexes=indexes, **made, **asked))
            c = M.cards(e, plain)
            evidence = add(evidence, e.withColumn("mode", F.lit(m)))
            cards = add(cards, c.join(M.supported(c), "query_id").select("query_id", "answerable", "supported", "confidence", F.lit(m).alias("mode")))
        if stored:
            for name, gone in stored.lacking(sorted({x for m in modes for x in retrieve.INDEXES[m]}), list(scope)).items():
                report["missing_indexes"].append({"index": name, "documents": gone, "modes": [m for m in modes if name in retrieve.INDEXES[m]], "cases": [i for i, _ in rows]})
    ids = lambda df: df.withColumnRenamed("query_id", "case_id")
    metrics = settled(case_metrics(table, ids(evidence), ids(cards)))
    by_mode = mode_metrics(metrics)
    report |= {"cases": [r.asDict(True) | ({"planner": own[r["case_id"]]} if r["mode"] == "planner" else {}) for r in metrics.orderBy("case_id", "mode").collect()], "modes": {r["mode"]: r.asDict() for r in by_mode.collect()}}
    if "planner" in modes and len(modes) > 1:
        report["planner_vs_static"] = [r.asDict(True) for r in planner_against_static(by_mode).orderBy("metric").collect()]
    if variants:
        got = settled(swept(hits, variants, table, k))
        told = {r["ordinal"]: r.asDict() for r in got.collect()}
        report["sweep"] = [{**v, **told[n]} for n, v in enumerate(variants)]
        names = spark.createDataFrame([(n, v["name"]) for n, v in enumerate(variants)], "ordinal int, variant string")
        report |= sweep_best(got.join(names, "ordinal")).first().asDict()
    report["visual_diagnostics"] = visual_diagnostics(ids(evidence), len(cases)) if cases else {}
    named = sorted({d for scope in by_scope for d in scope})
    inside = chunks.where(F.col("document_id").isin(*named)) if named else chunks.limit(0)
    n = graph.nodes(inside)
    relations = settled(graph.relation_counts(inside))  # at most eleven rows a document
    if cases and {"graph", "planner"} & set(modes):
        report["graph_diagnostics"] = graph_diagnostics(ids(evidence), relations, inside)
    documents = pages.where(F.col("document_id").isin(*named)).groupBy("document_id").agg(F.first("metadata").alias("metadata")) if named else pages.limit(0).select("document_id", "metadata")
    labelled: dict[str, str] = {}
    for part in (manifest, *manifest.get("queries", [])):
        labelled |= {str(d): str(t) for d, t in (part.get("document_quality_tiers") or {}).items()}
    tier_of = settled(tiers(documents, labelled))
    facts = extraction_facts(n, tier_of)
    counts = relations.withColumnRenamed("scope", "document_id").join(F.broadcast(tier_of), "document_id").select("document_id", "tier", "relation", "n")
    report["graph_extraction"] = [r.asDict(True) for r in extraction_by_tier(facts, counts).orderBy("tier").collect()]
    there = {r["document_id"] for r in n.select("document_id").distinct().collect()}  # of those that the manifest names
    report["missing_documents"] = [d for d in named if d not in there]
    report["expected"] = expected_by_tier(manifest)
    if report["expected"]:
        single = {"entities": "entity", "references": "reference", "sections": "section"}
        want = spark.createDataFrame([(e["tier"], single[e["kind"]], v) for e in report["expected"] for v in e["values"]], "tier string, kind string, name string")
        found = facts.join(F.broadcast(want.select("kind").distinct()), "kind").select("tier", "kind", "name").distinct()
        report["recall"] = [r.asDict(True) for r in recall_by_tier(want, found).orderBy("kind", "tier").collect()]
    return report


def markdown(report: dict) -> str:
    """The report as text. [B5]"""

    def table(title: str, rows: list[dict]) -> list[str]:
        if not rows:
            return []
        names = list(rows[0])
        show = lambda v: f"{v:.3f}" if isinstance(v, float) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
        return [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *("| " + " | ".join(show(r[n]) for n in names) + " |" for r in rows), ""]

    out = ["# Evaluation report", "", *table("Mode Metrics", list(report["modes"].values())), *table("Planner vs Static", report.get("planner_vs_static", [])), *table("Planner Sweep", report.get("sweep", [])), *table("Visual Diagnostics", [report[n] for n in ("visual_diagnostics",) if report.get(n)]), *table("Graph Diagnostics", [{x: y for x, y in report[n].items() if x != "rows"} for n in ("graph_diagnostics",) if report.get(n)]), *table("Graph Extraction", report.get("graph_extraction", [])), *table("Expected Values", report.get("expected", [])), *table("Recall", report.get("recall", [])), *table("Missing Indexes", report.get("missing_indexes", [])), *table("Queries", report["cases"])]
    return "\n".join(out)
