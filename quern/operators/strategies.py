"""Seven comparison strategies of answering, each a composition of retrievals over whole tables of questions.

``retrieve`` maps (query_id, text) to (query_id, chunk_id, source, text, rank, rerank). Every strategy returns
(query_id, contexts array<struct<source, text>>, answer, n_retrievals); contexts stand in order of first appearance.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grounding as g
from ..functions import lexicon as lx
from ..functions.scorers import Scorers
from ..functions.text import numbered_lines

Retrieve = Callable[[DataFrame], DataFrame]
NO_CONTEXT = "array<struct<source:string,text:string>>"


def _contexts(hits: DataFrame, k: int = lx.FINAL_K) -> DataFrame:
    """(query_id, contexts, top): at most ``k`` hits a query."""
    best = hits.where(F.col("rank") <= k).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "text"))).alias("c"), F.max("rerank").alias("top"))
    return best.select("query_id", F.transform("c", lambda x: F.struct(x["source"].alias("source"), x["text"].alias("text"))).alias("contexts"), "top")


class Strategies:
    """State of a row: query_id, question, contexts, top (best rerank), n_retrievals, answer."""

    def __init__(self, retrieve: Retrieve, scorers: Scorers | None = None):
        self.retrieve, self.scorers = retrieve, scorers or Scorers()

    def _start(self, questions: DataFrame) -> DataFrame:
        none = F.array().cast(NO_CONTEXT)
        return questions.select("query_id", F.col("text").alias("question"), none.alias("contexts"), F.lit(None).cast("double").alias("top"), F.lit(0).alias("n_retrievals"))

    def _look(self, state: DataFrame, query: Column, when: Column | None = None, k: int = lx.FINAL_K) -> DataFrame:
        """One more retrieval for the rows that ask for it; new contexts go behind those held."""
        asking = F.coalesce(query != "", F.lit(False)) & (F.lit(True) if when is None else F.coalesce(when, F.lit(False)))
        asked = state.where(asking).select("query_id", query.alias("text"))
        found = _contexts(self.retrieve(asked), k).select("query_id", F.col("contexts").alias("more"), F.col("top").alias("more_top"))
        joined = state.withColumn("asking", asking).join(found, "query_id", "left")
        return joined.withColumns(
            {
                "contexts": F.array_distinct(F.concat("contexts", F.coalesce("more", F.array().cast(NO_CONTEXT)))),
                "top": F.greatest("top", "more_top"),
                "n_retrievals": F.col("n_retrievals") + F.col("asking").cast("int"),
            }
        ).drop("more", "more_top", "asking")

    def _say(self, state: DataFrame) -> DataFrame:
        context = F.array_join(F.transform("contexts", lambda c: c["text"]), "\n")
        return state.withColumn("answer", F.when(F.size("contexts") > 0, self.scorers.generate(F.col("question"), context)).otherwise(""))

    def naive(self, q: DataFrame) -> DataFrame:
        return self._say(self._look(self._start(q), F.col("question")))

    def react(self, q: DataFrame, iterations: int = 3) -> DataFrame:
        """Each further query is the question and the start of the last observation."""
        state = self._look(self._start(q), F.col("question"))
        for _ in range(iterations - 1):
            last = F.substring(F.coalesce(F.try_element_at("contexts", F.lit(-1))["text"], F.lit("")), 1, 100)
            state = self._look(state, F.concat_ws(" ", "question", last))
        return self._say(state)

    def adaptive(self, q: DataFrame, sub_questions: Column, limit: int = 3) -> DataFrame:
        """A question without parts is asked as it is, else each of its first parts (a column of numbered lines)."""
        state = self._start(q.withColumn("text", F.col("text"))).join(q.select("query_id", sub_questions.alias("parts")), "query_id")
        parts = F.when(F.trim(F.coalesce("parts", F.lit(""))) != "", numbered_lines(F.col("parts"), limit)).otherwise(F.array("question"))
        state = state.withColumn("parts", parts)
        for i in range(limit):
            state = self._look(state, F.coalesce(F.get("parts", F.lit(i)), F.lit("")))
        return self._say(state.drop("parts"))

    def hyde(self, q: DataFrame, hypothetical: Column) -> DataFrame:
        """By a hypothetical answer and by the question, together."""
        state = self._start(q).join(q.select("query_id", hypothetical.alias("made_up")), "query_id")
        return self._say(self._look(self._look(state, F.coalesce("made_up", F.lit(""))), F.col("question")).drop("made_up"))

    def self_rag(self, q: DataFrame, least: float = lx.CLAIM_GROUNDED) -> DataFrame:
        """Contexts that aren't relevant go; an answer that they don't support is sought once more."""
        state = self._look(self._start(q), F.col("question"))
        relevant = F.filter("contexts", lambda c: self.scorers.rerank(F.col("question"), c["text"]) > 0)
        state = self._say(state.withColumn("contexts", relevant))
        supported = g.best_overlap(F.col("answer"), F.transform("contexts", lambda c: c["text"])) >= least
        again = (F.size("contexts") == 0) | ~supported
        return self._say(self._look(state, F.concat_ws(" ", "question", F.lit(lx.MORE_DETAILS)), again))

    def flare(self, q: DataFrame, sentences: int = 5, retries: int = 3) -> DataFrame:
        """Sentences of a draft that no context supports are looked up, a few at most."""
        state = self._say(self._look(self._start(q), F.col("question")))
        texts = F.transform("contexts", lambda c: c["text"])
        unsure = F.filter(g.split_claims(F.col("answer"), sentences), lambda c: g.best_overlap(c, texts) < lx.CLAIM_GROUNDED)
        state = state.withColumn("unsure", F.slice(unsure, 1, retries))
        for i in range(retries):
            state = self._look(state, F.coalesce(F.get("unsure", F.lit(i)), F.lit("")))
        return self._say(state.drop("unsure"))

    def crag(self, q: DataFrame, good: float = 0.7, poor: float = 0.3) -> DataFrame:
        """CORRECT keeps what was found, INCORRECT replaces it by a second search, AMBIGUOUS takes both."""
        state = self._look(self._start(q), F.col("question"))
        verdict = F.when(F.col("top") >= good, "CORRECT").when(F.coalesce("top", F.lit(0.0)) < poor, "INCORRECT").otherwise("AMBIGUOUS")
        state = state.withColumn("verdict", verdict)
        kept = F.when(F.col("verdict") == "INCORRECT", F.array().cast(NO_CONTEXT)).otherwise(F.col("contexts"))
        state = self._look(state.withColumn("contexts", kept), F.concat_ws(" ", "question", F.lit(lx.MORE_DETAILS)), F.col("verdict") != "CORRECT")
        return self._say(state)
