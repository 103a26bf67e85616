"""Questions answered end to end: parse, route, look up or search, rerank, and say what was found."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.operators import entities, intent, lookup, retrieval, sqlguard
from quernstone.sources.tables import audit

REFUSAL = "The documents found don't contain enough information to answer this question."
LENGTHS = {"document": 500, "answer": 800, "passage": 1500, "fallback": 600}


@dataclass
class Hooks:
    """Models from outside; without one the documented fallback applies.

    ``generate`` (prompt -> text; else the best passage), ``to_sql`` (question, prompt of views -> SQL; else no analytical
    path), ``embed`` (texts -> vectors; else lexical search alone), ``rerank`` (queries, passages -> scores; else the order
    of the search), ``grounded`` (answer, context -> bool; else every answer stands).
    """

    generate: Callable[[str], str] | None = None
    to_sql: Callable[..., str] | None = None
    embed: Callable[[pd.Series], pd.Series] | None = None
    rerank: Callable[[pd.Series, pd.Series], pd.Series] | None = None
    grounded: Callable[[str, str], bool] | None = None


class Answerer:
    """``documents``: doc_id, text and, where there is, metadata (string map) and embedding."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], documents: DataFrame, log: str | None = None, generate: Callable[[str], str] | None = None, to_sql: Callable[..., str] | None = None, hooks: Hooks | None = None, threshold: float = 0.0):
        self.spark, self.tables, self.documents, self.log, self.threshold = spark, tables, documents, log, threshold
        self.hooks = hooks or Hooks(generate=generate, to_sql=to_sql)

    def answer(self, question: str, k: int = 5) -> dict:
        """answer, documents, intent, query_path; never raises, always audits."""
        started, path, ids, sql, error = time.time(), "error", [], None, None
        try:
            row = intent.route(intent.parse(self.spark.createDataFrame([(question,)], "question string"))).first().asDict()
            path = row["route"]
            found: list[tuple[str, str]] = []
            if path == "analytical" and self.hooks.to_sql is not None:
                sql = self.hooks.to_sql(question)
                rows = sqlguard.run(self.spark, sql)
                found = [(f"analytical:{i}", " | ".join(f"{c}: {v}" for c, v in r.asDict().items() if v is not None)) for i, r in enumerate(rows)]
            elif path in ("sql", "hybrid"):
                found = self.exact(row)
            exact = bool(found)
            if not found or path == "hybrid":
                known = {i for i, _ in found}
                found += [h for h in self.search(question, k, row, bool(found)) if h[0] not in known]
            ids = [i for i, _ in found]
            return {"answer": self.say(question, found, exact), "documents": found, "intent": row, "query_path": path}
        except Exception as e:  # noqa: BLE001 - an answer is given whatever happens
            path, error = "error", str(e)
            return {"answer": "The question could not be answered.", "documents": [], "intent": None, "query_path": path}
        finally:
            if self.log is not None:
                audit(self.log, question, path, sql, ids, started, error)

    def _named(self, table: DataFrame, name: str | None) -> DataFrame:
        """id, score of the rows whose name is close to the one asked for."""
        asked = self.spark.createDataFrame([(0, name)] if name else [], "id long, name string")
        return entities.fuzzy_matches(asked, table.select("id", "name")).select("id", "score")

    def exact(self, parsed: dict, limit: int = 30) -> list[tuple[str, str]]:
        """Rows by identifiers and close names: providers, else the records of one admission, else those of a patient."""
        patients, providers, records = (self.tables[t] for t in ("patients", "providers", "records"))
        field = F.lit(parsed["specific_field"])
        asked = lambda text, columns: lookup.with_asked(text, field, lookup.specific_field(field, columns))
        if parsed["provider_npi"] or parsed["provider_name"]:
            by_number = providers.where(F.col("npi") == F.lit(parsed["provider_npi"])).select("id", F.lit(2.0).alias("score"))
            hits = by_number.unionByName(self._named(providers, parsed["provider_name"])).groupBy("id").agg(F.max("score").alias("score"))
            best = providers.join(hits, "id").orderBy(F.desc("score"), "id").limit(limit)
            return [(f"sql:provider:{r['id']}", r["content"]) for r in best.select("id", asked(lookup.provider_text(), providers.columns).alias("content")).collect()]
        person = parsed["patient_name"] or parsed["patient_id"] or parsed["subject_id"]
        before: list[tuple[str, str]] = []
        if parsed["hadm_id"] and "admissions" in self.tables:
            admissions = self.tables["admissions"]
            own = admissions.where(F.col("hadm_id") == parsed["hadm_id"]).orderBy("id").limit(1)
            before = [(f"sql:admission:{r['id']}", r["content"]) for r in own.select("id", asked(lookup.admission_text(), admissions.columns).alias("content")).collect()]
        if parsed["hadm_id"] and not person:
            chosen = lookup.by_admission(records, parsed["hadm_id"], limit)
        else:
            people = entities.resolve(patients, parsed["subject_id"], parsed["patient_id"], self._named(patients, parsed["patient_name"])).select("id").distinct()
            if parsed["specific_field"] in lookup.DEMOGRAPHIC:
                own = patients.join(people, "id", "left_semi").orderBy("id").limit(limit)
                before += [(f"sql:patient:{r['id']}", r["content"]) for r in own.select("id", asked(lookup.demographics_text(), patients.columns).alias("content")).collect()]
            chosen = records.join(people.select(F.col("id").alias("patient_id")), "patient_id", "left_semi")
            if parsed["date"]:
                chosen = chosen.where(F.col("record_date") == parsed["date"])
            chosen = chosen.orderBy(F.desc_nulls_first("record_date"), F.desc("id")).limit(limit)
            if parsed["hadm_id"]:
                chosen = chosen.where(F.col("hadm_id") == parsed["hadm_id"])
        joined = lookup.patient_records(chosen, patients, providers)
        order = [F.desc_nulls_first("record_date"), F.desc("id")] if person else ["id"]
        full = joined.orderBy(*order).select("id", asked(lookup.record_text(), joined.columns).alias("content"))
        return before + [(f"sql:{r['id']}", r["content"]) for r in full.collect()]

    def search(self, question: str, k: int, parsed: dict | None = None, confirmed: bool = False) -> list[tuple[str, str]]:
        """Lexical and, with embeddings, semantic search, fused; above the threshold, reranked.

        The asked document type filters first. A filter that leaves nothing is dropped, unless an exact lookup has confirmed
        whom the question is about.
        """
        kind = (parsed or {}).get("doc_type")
        pool = self.documents
        if kind and "metadata" in pool.columns:
            pool = retrieval.filtered(pool, {"doc_type": kind}, keep_empty=confirmed)
        asked = self.spark.createDataFrame([(0, question)], "query_id long, text string")
        size = retrieval.fetch_size(k)
        hits = retrieval.bm25_top(pool.select("doc_id", "text"), asked, size).select("query_id", "doc_id", "score", "rank")
        if self.hooks.embed is not None and "embedding" in pool.columns:
            vector = retrieval.embedded(asked, self.hooks.embed).select("query_id", "embedding")
            near = retrieval.nearest(pool.select(F.col("doc_id").alias("vec_id"), "embedding"), vector, size)
            hits = retrieval.hybrid(hits, near.select("query_id", F.col("vec_id").alias("doc_id"), F.col("similarity").alias("score"), "rank"), size)
        kept = retrieval.above_threshold(hits, self.threshold).join(pool.select("doc_id", F.col("text").alias("content")), "doc_id").withColumn("query", F.lit(question))
        best = retrieval.rerank(kept, k, self.hooks.rerank).orderBy("rank")
        return [(str(r["doc_id"]), r["content"]) for r in best.select("doc_id", "content").collect()]

    def say(self, question: str, found: list[tuple[str, str]], exact: bool) -> str:
        """The generated answer where it is grounded, else a refusal; without a model the best passage."""
        if not found:
            return "No matching records found."
        length = LENGTHS["answer"] if exact else LENGTHS["passage"]
        context = "\n\n".join(text[:length] for _, text in found)
        if self.hooks.generate is not None:
            try:
                said = self.hooks.generate(f"Question: {question}\n\nContext:\n{context}")
                return said if self.hooks.grounded is None or self.hooks.grounded(said, context) else REFUSAL
            except Exception:  # noqa: BLE001 - an absent model falls back to what was found
                pass
        return found[0][1][: LENGTHS["fallback"]]
