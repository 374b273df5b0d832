"""The engine's surface: one method a tool, over named tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import catalog as C
from tessel.operators import search as S
from tessel.operators import state as X
from tessel.plans import providers as P


class Engine:
    """Tables by name (chunks, summaries, works, thoughts, messages, conversations, tensor, directions) and a text embedder.

    Search methods take a text or a vector. Methods that change a table return the new one;
    writing it is the caller's decision.
    """

    def __init__(self, tables: dict[str, DataFrame], embed: P.Embed = P.hashed_bag) -> None:
        self.tables, self.embed = tables, embed

    def _vector(self, query) -> list[float]:
        if isinstance(query, str):
            if not 1 <= len(query) <= 1000:
                raise ValueError("a query has 1 to 1000 characters")
            return [float(x) for x in self.embed([query])[0]]
        return list(query)

    @staticmethod
    def _limit(limit: int, most: int = 500) -> int:
        if not 1 <= limit <= most:
            raise ValueError(f"a limit is 1 to {most}")
        return limit

    def ping(self) -> str:
        return "ok"

    def search_chunks(self, query, limit: int = 10, min_similarity: float = 0.0, author_filter=None, work_filter=None, language_filter=None) -> DataFrame:
        if not 0 <= min_similarity <= 1:
            raise ValueError("a similarity is 0 to 1")
        where = S.equal_filters(author=author_filter, work_title=work_filter, language=language_filter)
        hits = S.at_least(S.knn(self.tables["chunks"], self._vector(query), self._limit(limit), where), min_similarity)
        return hits.withColumn("canonical_reference", T.canonical_reference(F.col("section_path")))

    def search_summaries(self, query, limit: int = 10, min_level: int | None = None, max_level: int | None = None) -> DataFrame:
        where = F.lit(True)
        for level, test in ((min_level, F.col("level") >= (min_level or 0)), (max_level, F.col("level") <= (max_level or 0))):
            if level is not None:
                if not 1 <= level <= 5:
                    raise ValueError("a level is 1 to 5")
                where &= test
        return S.knn(self.tables["summaries"], self._vector(query), self._limit(limit), where)

    def search(self, query: str, limit: int = 20, sections: int = 5, force_mode: str | None = None, author_filter=None, work_filter=None) -> DataFrame:
        """Simple, summary or two-stage search; filters by author and work hold for chunks and sections; without a mode the question decides, and an empty two-stage result falls back to simple."""
        mode = force_mode
        if mode is None:
            spark = self.tables["chunks"].sparkSession
            mode = "hierarchical" if spark.range(1).select(T.needs_hierarchy(F.lit(query))).head()[0] else "simple"
        v = self._vector(query)
        if mode == "summary":
            return S.knn(self.tables["summaries"], v, self._limit(limit))
        if mode == "hierarchical":
            found = S.hierarchical(self.tables["summaries"].withColumnRenamed("section_path", "path"), self.tables["chunks"], v, sections, self._limit(limit), self.tables.get("works"), author_filter, work_filter)
            if not found.isEmpty():
                return found
        return S.knn(self.tables["chunks"], v, self._limit(limit), S.equal_filters(author=author_filter, work_title=work_filter))

    def retrieve_context(self, query, limit: int = 25, works: list[str] | None = None, pool: int = 200, authors: int = 8, per_author: int = 3) -> DataFrame:
        return S.diverse(self.tables["chunks"], self._vector(query), pool, authors, per_author, self._limit(limit), S.equal_filters(work_title=works))

    def get_document(self, source_id, include_chunks: bool = False, chunk_limit: int = 50) -> dict[str, DataFrame]:
        out = {"document": self.tables["works"].where(F.col("source_id") == source_id).limit(1)}
        if include_chunks:
            out["chunks"] = self.get_chunks_by_document(source_id, chunk_limit)
        return out

    def list_documents(self, author_filter=None, work_filter=None, language_filter=None, limit: int = 50, offset: int = 0) -> DataFrame:
        where = S.equal_filters(author=author_filter, title=work_filter, language=language_filter)
        return C.page(self.tables["works"].where(where), ["source_id"], self._limit(limit), offset)

    def get_chunks_by_document(self, source_id, limit: int = 50, offset: int = 0, section_filter: str | None = None) -> DataFrame:
        rows = self.tables["chunks"].where(F.col("source_id") == source_id)
        rows = rows if section_filter is None else rows.where(F.col("section_path").startswith(section_filter))
        return C.page(rows, ["order_index", "id"], self._limit(limit), offset)

    def filter_by_author(self, author: str, include_chunk_counts: bool = True) -> DataFrame:
        works = self.tables["works"].where(F.col("author") == author).select(F.col("title").alias("work_title"), "author")
        return C.author_rollup(works, self.tables["chunks"]) if include_chunk_counts else works

    def delete_document(self, source_id, confirm: bool = False) -> tuple[dict[str, DataFrame], DataFrame]:
        doomed = self.tables["works"].where(F.col("source_id") == source_id)
        held = {n: t for n, t in self.tables.items() if "source_id" in t.columns}
        return C.delete_cascade(held, "source_id", doomed, confirm)

    def _added(self, table: str, values: dict) -> DataFrame:
        old = self.tables[table]
        row = {**values, "vector": self._vector(values["content"])} if "vector" in old.columns else values
        new = old.sparkSession.createDataFrame([tuple(row.get(c) for c in old.columns)], old.schema)
        return old.unionByName(new)

    def add_thought(self, content: str, id, thought_type: str = "reflection", **fields) -> DataFrame:
        return self._added("thoughts", {"content": content, "id": id, "thought_type": thought_type, **fields})

    def search_thoughts(self, query, limit: int = 10, thought_type_filter=None) -> DataFrame:
        return S.knn(self.tables["thoughts"], self._vector(query), self._limit(limit), S.equal_filters(thought_type=thought_type_filter))

    def get_thought(self, id) -> DataFrame:
        return self.tables["thoughts"].where(F.col("id") == id)

    def update_thought_evolution_stage(self, id, stage: str) -> DataFrame:
        if stage not in ("nascent", "developing", "mature", "revised", "abandoned"):
            raise ValueError("unknown stage")
        old = self.tables["thoughts"]
        change = old.sparkSession.createDataFrame([(id, stage)], ["id", "evolution_stage"])
        return C.updated(old, change, "id")

    def add_message(self, content: str, id, role: str, conversation_id, order_index: int = 0) -> DataFrame:
        return self._added("messages", {"content": content, "id": id, "role": role, "conversation_id": conversation_id, "order_index": order_index})

    def get_messages(self, conversation_id, limit: int = 50) -> DataFrame:
        return self.tables["messages"].where(F.col("conversation_id") == conversation_id).orderBy("order_index", "id").limit(self._limit(limit))

    def search_messages(self, query, limit: int = 10, conversation_id_filter=None) -> DataFrame:
        return S.knn(self.tables["messages"], self._vector(query), self._limit(limit), S.equal_filters(conversation_id=conversation_id_filter))

    def get_conversation(self, conversation_id) -> DataFrame:
        return self.tables["conversations"].where(F.col("conversation_id") == conversation_id).limit(1)

    def search_conversations(self, query, limit: int = 10, category_filter=None) -> DataFrame:
        return S.knn(self.tables["conversations"], self._vector(query), self._limit(limit), S.equal_filters(category=category_filter), key="conversation_id")

    def list_conversations(self, limit: int = 20, category_filter=None) -> DataFrame:
        rows = self.tables["conversations"].where(S.equal_filters(category=category_filter))
        return C.latest(rows, "ts_start", self._limit(limit), "conversation_id").withColumn("summary", T.shortened(F.col("summary"), 100))

    def _memories(self) -> dict[str, DataFrame]:
        thoughts = self.tables["thoughts"].select(F.col("id").cast("string").alias("id"), "ts", "content", "vector")
        talks = self.tables["conversations"].select(F.col("conversation_id").cast("string").alias("id"), F.col("ts_start").alias("ts"), F.col("summary").alias("content"), "vector")
        return {"thought": thoughts, "conversation": talks}

    def search_memories(self, query=None, n_results: int = 5, filter_type: str | None = None, since=None, before=None, sort_by: str = "relevance") -> DataFrame:
        if not 1 <= n_results <= 20:
            raise ValueError("n_results is 1 to 20")
        sources = {n: t for n, t in self._memories().items() if filter_type in (None, n)}
        return S.unified(sources, None if not query else self._vector(query), n_results, since, before, sort_by)

    def trace_concept_evolution(self, concept, limit: int = 10) -> DataFrame:
        return S.timeline(self._memories(), self._vector(concept), self._limit(limit))

    def check_consistency(self, statement) -> DataFrame:
        return S.consistency(self._memories(), self._vector(statement))

    def consistency_evidence(self, statement) -> DataFrame:
        return S.consistency_evidence(self._memories(), self._vector(statement))

    def get_state_tensor(self, state_id: int | None = None, entity: str | None = None) -> DataFrame:
        rows = self.tables["tensor"].where(S.equal_filters(entity=entity)) if entity else self.tables["tensor"]
        if state_id is None:
            top = rows.agg(F.max("state_id").alias("state_id"))
            return rows.join(F.broadcast(top), "state_id")
        return rows.where(F.col("state_id") == state_id)

    def get_state_profile(self, state_id: int | None = None) -> DataFrame:
        return X.projection(self.get_state_tensor(state_id), self.tables["directions"], F.col("dim"))

    def compare_profiles(self, a: int, b: int, categories: list[str] | None = None) -> DataFrame:
        left, right = (self.get_state_profile(s).where(S.equal_filters(category=categories)) for s in (a, b))
        return X.compare_profiles(left, right)
