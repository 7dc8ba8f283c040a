"""The engine: index, retrieve, ask, plan and verify over DataFrames of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import language as la
from .functions import lexicon as lx
from .functions.scorers import Scorers, message
from .functions.text import arabic_tokens, bm25_tokens, french_tokens
from .operators import agent, chunking, index, vectors, verify
from .session import Scratch
from .sources import files


def _intents(questions: DataFrame) -> Column:
    """A model's labels, if the questions carry them in ``intents``."""
    return F.coalesce("intents", F.array().cast("array<string>")) if "intents" in questions.columns else F.array().cast("array<string>")


class Engine:
    """Questions come as (query_id, text), with a model's labels in ``intents`` (array<string>) if there are any; each step is one plan over all of them."""

    def __init__(self, spark: SparkSession, scorers: Scorers | None = None):
        self.spark, self.scorers, self.chunks, self.path = spark, scorers or Scorers(), None, None

    def build_index(self, pages: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
        """Chunk ``pages`` (id, text, source, page); keep chunks by language bucket, their lexical and vector indexes and article keys."""
        chunks = chunking.number_chunks(chunking.chunk_pages(pages, id_col), id_col)
        chunks = chunks.join(pages.select(id_col, "source", "page"), id_col)
        files.write_index(chunks, f"{path}/chunks")
        written = files.read_index(self.spark, f"{path}/chunks")
        index.write_lexical(written, bm25_tokens(F.col("text"), F.col("language")), f"{path}/lexical", "chunk_id")
        embedded = self.scorers.embed(written, "chunk_id", bm25_tokens(self.scorers.enrich(F.col("text")), F.col("language")))
        vectors.write_vectors(embedded, f"{path}/vectors", "chunk_id", "vector")
        agent.article_keys(written, "chunk_id").write.mode("overwrite").parquet(f"{path}/articles")
        self.load(path)
        return self.chunks

    def load(self, path: str) -> bool:
        """Open an index; False where a table of it isn't there."""
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        for part in ("chunks", "lexical/blocks", "vectors/blocks", "articles"):
            at = jvm_path(f"{path}/{part}/_SUCCESS")
            if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
                return False
        self.path, self.chunks = path, files.read_index(self.spark, f"{path}/chunks")
        return True

    def status(self) -> DataFrame:
        return self.chunks.groupBy("lang_bucket").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"))

    def retrieve(self, questions: DataFrame, k: int = lx.RETRIEVE_K) -> DataFrame:
        """(query_id, chunk_id, rrf, rank, rerank, text, source, page, language): fused, filtered, reranked."""
        c = self.chunks
        sparse = index.search_lexical(self.spark, f"{self.path}/lexical", questions, french_tokens(F.col("text")), id_col="chunk_id", query_col="query_id", k=k)
        asked = self.scorers.embed(questions, "query_id", F.concat(french_tokens(F.col("text")), arabic_tokens(F.col("text"))))
        lead, _ = vectors.search_vectors(self.spark, f"{self.path}/vectors", asked, query_col="query_id", vec_col="vector", id_col="chunk_id", k=k)
        lead = lead.where(F.col("score") >= lx.DENSE_FLOOR)
        hits = index.fuse(lead, sparse, query_col="query_id", id_col="chunk_id").where(F.col("rank") <= k)
        hits = hits.join(c.select("chunk_id", "text", "source", "page", "language"), "chunk_id")
        hits = index.drop_garbage(hits, F.col("text"), "query_id").join(questions.select("query_id", F.col("text").alias("question"), _intents(questions).alias("intents")), "query_id")
        hits = hits.withColumn("rerank", self.scorers.rerank(index.rerank_pair(F.col("question"), F.col("intents"), F.col("language")), F.col("text"))).drop("intents")
        best = Window.partitionBy("query_id").orderBy(F.desc(F.round("rerank", 9)), "rank")
        return hits.withColumn("place", F.row_number().over(best)).drop("rank").withColumnRenamed("place", "rank")

    def understand(self, questions: DataFrame) -> DataFrame:
        text = F.col("text")
        told = la.ensemble_language(questions, "text").withColumn("hop", la.multihop(text))
        flags = la.question_flags(_intents(questions), F.col("hop.is_multihop"), la.is_legal(text), la.is_out_of_scope(text))
        return told.withColumn("flags", flags).drop("hop")

    def plan(self, understood: DataFrame) -> DataFrame:
        return agent.fallback_plan(understood.select("query_id", F.col("flags.intents").alias("intents")), "query_id")

    def _scored(self, questions: DataFrame) -> DataFrame:
        return self.retrieve(questions).withColumn("score", F.col("rerank"))

    def ask(self, questions: DataFrame, audit_path: str | None = None) -> DataFrame:
        """One row per question: answer, route, verification and decision; a refusal or abstention where that is due.

        Questions of several steps go through plan, execution, memory and reflection (``agent.run``); all answers are
        verified against the chunks of every retrieval made for them, and audits are added under ``audit_path``.
        """
        keep = Scratch(self.spark, "ask").keep
        asked = keep(self.understand(questions))
        hits = keep(self.retrieve(questions).where(F.col("rank") <= lx.FINAL_K))
        context = index.context_of(hits, "query_id").join(hits.groupBy("query_id").agg(F.max("rerank").alias("top_rerank")), "query_id")
        rows = asked.join(context, "query_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
        rows = keep(rows.withColumn("route", F.when(F.col("top_rerank") < lx.OOS_RERANK, "abstain").otherwise(agent.route(F.col("n_chunks"), F.col("flags")))))
        several = rows.where("route = 'multihop'").select("query_id", "text", "language", "flags")
        plan = keep(self.plan(several))
        tools = agent.Tools(self._scored, self.chunks, self.spark.read.parquet(f"{self.path}/articles"))
        reasoned, self.trace, evidence = agent.run(several.drop("flags"), plan, tools, self.scorers.generate, keep)
        more = evidence.join(self.chunks.select("chunk_id", "text"), "chunk_id").select("query_id", "chunk_id", "source", "text", (F.col("place") + lx.FINAL_K + 1).alias("rank"))
        every = hits.select("query_id", "chunk_id", "source", "text", "rank").unionByName(more)
        first = every.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("rank"), F.first("source").alias("source"), F.first("text").alias("text"))
        chunks = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "text"))).alias("c"))  # of a few retrievals and a bounded memory
        chunks = chunks.select("query_id", F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["text"].alias("text"))).alias("chunks"))
        facts = F.filter(F.transform("facts", lambda f: f["fact"]), lambda x: x != "")
        rows = rows.join(chunks, "query_id", "left").join(reasoned.select("query_id", facts.alias("intermediate"), F.col("answer").alias("reasoned")), "query_id", "left")
        said = F.coalesce(F.nullif("reasoned", F.lit("")), self.scorers.generate(F.col("text"), F.regexp_replace("context", r"\[Source:[^\]]*\]", "")), F.lit(""))
        rows = rows.withColumns({"answer": said, "is_multihop": F.col("route") == "multihop"})
        rows = verify.verify(rows, message("abstain", F.col("language")), self.scorers.entail)
        self.verified = rows = keep(rows)  # for verify.debug_report
        if audit_path:
            files.append_audits(verify.audit_rows(rows.withColumn("question", F.col("text")), "question"), audit_path)
        legal = F.when(F.col("flags.LEGAL"), F.concat(F.lit("\n"), message("legal", F.col("language")))).otherwise("")
        answer = (
            F.when(F.col("route") == "refuse", message("refuse", F.col("language")))
            .when((F.col("route") == "abstain") | F.col("is_abstained"), message("abstain", F.col("language")))
            .otherwise(F.concat("answer", legal))
        )
        decided = F.col("is_grounded") & F.col("route").isin("direct", "multihop")
        return rows.select("query_id", F.col("text").alias("question"), "language", "route", answer.alias("answer"), "n_chunks", "claim_ratio", "entity_ratio", "chain_verified", "cfi",
                           decided.alias("grounded"), "is_abstained", "warnings", "entities", "intermediate", F.lit(self.scorers.methods["generate"]).alias("method"))
