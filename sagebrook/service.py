"""The engine behind one object: projects, files, chunks, vectors, questions and chats of users.

Tables are Parquet under one root. Ids are hashes of what they name, so that doing something twice
gives the same rows; chunks and vectors are partitioned by project, and only a project's own
partition is ever replaced.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import questions as Q
from .functions.text import needs_continuation
from .models import Embedder, FirstPassage, Generator, HashEmbedder, OverlapReranker, Reranker
from .operators import catalog, enrich, fusion, state
from .operators.dense import nearest
from .operators.keyed_table import KeyedTable
from .operators.sparse import query_tokens
from .plans import ingest, search
from .schema import CHAT, LEDGER, PROJECTS, PROMPTS
from .session import Settings, with_checkpoints
from .sources import files

ASSETS = "asset_id long, project_id long, file_name string, path string"
CHUNKS = "chunk_id long, asset_id long, file_name string, page int, chunk_order int, text string, project_id long"


def identifier(*parts: Column) -> Column:
    return F.abs(F.xxhash64(*parts))


class Service:
    def __init__(
        self, spark: SparkSession, root: str, *, embedder: Embedder | None = None, reranker: Reranker | None = None, generator: Generator | None = None,
        pdf_pages: files.Pages | None = None, settings: Settings | None = None,
    ):
        self.spark, self.root, self.settings = with_checkpoints(spark), root, settings or Settings()
        self.embedder, self.reranker, self.generator = embedder or HashEmbedder(), reranker or OverlapReranker(), generator or FirstPassage()
        self.pdf_pages = pdf_pages
        self.vectors = catalog.Collections(spark, f"{root}/vectors")
        self.chats = KeyedTable(self.spark, f"{root}/chat", CHAT, "session_id")
        self.own_prompts = KeyedTable(self.spark, f"{root}/prompts", PROMPTS, "project_id")

    def _read(self, name: str, schema: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        there = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}") if there else self.spark.createDataFrame([], schema)

    def _add(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("append").parquet(f"{self.root}/{name}")

    def _owned(self, user_id: str, project_id: int) -> None:
        """Every call is a user's, and sees the user's own projects only."""
        if not (user_id or "").strip():
            raise PermissionError("no user")
        if self._read("projects", PROJECTS).where((F.col("project_id") == project_id) & (F.col("user_id") == user_id)).isEmpty():
            raise LookupError(f"no project {project_id}")

    def create_project(self, user_id: str, name: str) -> int:
        """The project of this name, made if it isn't there."""
        if not (user_id or "").strip():
            raise PermissionError("no user")
        if not (name or "").strip():
            raise ValueError("a project needs a name")
        now = F.lit(datetime.now(timezone.utc))
        row = self.spark.range(1).select(
            identifier(F.lit(user_id), F.lit(name)).alias("project_id"), F.sha2(F.concat_ws("/", F.lit(user_id), F.lit(name)), 256).alias("project_uuid"), F.lit(name).alias("project_name"),
            F.lit(user_id).alias("user_id"), now.alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"),
        )
        new = row.join(self._read("projects", PROJECTS).select("project_id"), "project_id", "left_anti").select(row.columns)
        self._add(new, "projects")
        return row.first().project_id

    def projects(self, user_id: str, number: int = 1, size: int = 10) -> DataFrame:
        return catalog.page(self._read("projects", PROJECTS).where(F.col("user_id") == user_id), "project_name", number, size)

    def process(self, user_id: str, project_id: int, path: str, *, reset: bool = False) -> bool:
        """Load, clean and cut the files under a path that the project hasn't yet, or all of them in
        place of what it has. Does nothing, and says so, if the same files were done before or are
        being worked on."""
        self._owned(user_id, project_id)
        records = files.with_metadata(files.load(self.spark, path, self.pdf_pages)).withColumn("asset_id", identifier(F.lit(project_id), "path"))
        found = records.select("asset_id", F.lit(project_id).alias("project_id"), "file_name", "path").distinct().checkpoint()
        mark = found.agg(catalog.fingerprint(F.col("asset_id"), F.col("file_name"))).first()[0]
        task = self._begin("process", {"fingerprint": mark, "project_id": project_id, "reset": reset})
        if task is None:
            return False
        try:
            assets = self._read("assets", ASSETS)
            new = found if reset else found.join(assets.select("asset_id"), "asset_id", "left_anti").select(found.columns)
            rows = records.join(new.select("asset_id"), "asset_id", "left_semi")
            chunks = ingest.numbered(ingest.split(rows, self.settings.chunk_size, self.settings.chunk_overlap), "asset_id", "page", "row")
            chunks = chunks.select(identifier("asset_id", "chunk_order").alias("chunk_id"), "asset_id", "file_name", "page", "chunk_order", F.col("chunk_text").alias("text"), F.lit(project_id).alias("project_id"))
            if reset:
                self.vectors.drop(self.embedder.size, project_id)
            writer = chunks.write.partitionBy("project_id").option("partitionOverwriteMode", "dynamic")
            writer.mode("overwrite" if reset else "append").parquet(f"{self.root}/chunks")
            self._add(found.join(assets.select("asset_id"), "asset_id", "left_anti").select(found.columns), "assets")
        except Exception:
            self._end(task, "FAILURE")
            raise
        self._end(task, "SUCCESS")
        return True

    def _begin(self, name: str, args: dict[str, object]) -> DataFrame | None:
        now = datetime.now(timezone.utc)
        hashed = state.args_hash(F.lit(name), {k: state.json_text(F.lit(v)) if isinstance(v, str) else F.lit(v) for k, v in args.items()})
        row = self.spark.range(1).select(F.lit(name).alias("task_name"), hashed.alias("task_args_hash"))
        last = state.latest(self._read("ledger", LEDGER).join(row, ["task_name", "task_args_hash"], "left_semi"), ["task_args_hash"], "updated_at").select("status", "started_at").first()
        status, started = (last.status, last.started_at) if last else (None, None)
        run = self.spark.range(1).select(state.should_execute(F.lit(status).cast("string"), F.lit(started).cast("timestamp"), F.lit(now), self.settings.task_time_limit)).first()[0]
        if not run:
            return None
        none = F.lit(None)
        task = row.select(
            identifier("task_args_hash", F.lit(now)).alias("execution_id"), "task_name", "task_args_hash", none.cast("string").alias("task_id"), F.lit("STARTED").alias("status"), none.cast("string").alias("task_args"),
            none.cast("string").alias("result"), F.lit(now).alias("started_at"), none.cast("timestamp").alias("completed_at"), F.lit(now).alias("created_at"), F.lit(now).alias("updated_at"),
        )
        self._add(task, "ledger")
        return task

    def _end(self, task: DataFrame, status: str) -> None:
        now = F.lit(datetime.now(timezone.utc))
        self._add(task.withColumns({"status": F.lit(status), "completed_at": now, "updated_at": now}), "ledger")

    def chunks(self, user_id: str, project_id: int) -> DataFrame:
        self._owned(user_id, project_id)
        return self._read("chunks", CHUNKS).where(F.col("project_id") == project_id)

    def push(self, user_id: str, project_id: int) -> int:
        """Embed and store the chunks that aren't stored yet; how many vectors there are then."""
        own = F.to_json(F.struct("file_name", "page", "chunk_order", "asset_id"))
        rows = self.chunks(user_id, project_id).select("chunk_id", F.col("text").alias("chunk_text"), own.alias("metadata"))
        ingest.index(rows, self.vectors, self.embedder, project_id)
        found = self.vectors.info(self.embedder.size, project_id)
        return found["records"] if found else 0

    def coverage(self, user_id: str, project_id: int) -> DataFrame:
        chunks = self.chunks(user_id, project_id)
        assets = self._read("assets", ASSETS).where(F.col("project_id") == project_id)
        return catalog.coverage(assets, chunks, chunks.join(self.vectors.indexed_ids(self.embedder.size, project_id), "chunk_id", "left_semi").select("asset_id"))

    def search(self, user_id: str, project_id: int, questions: list[str], metadata: dict[str, object] | None = None) -> DataFrame:
        """(query_id, query, id, text, score, rank, and the chunk's place) for a batch of questions,
        numbered from 0: hybrid search, widened by derived questions where a question has some. With
        ``metadata`` only chunks count whose own (file_name, page, chunk_order, asset_id) contain it."""
        chunks = self.chunks(user_id, project_id)
        vectors = self.vectors.read(self.embedder.size, project_id).select("id", "vector")
        if metadata:
            own = F.to_json(F.struct("file_name", "page", "chunk_order", "asset_id"))
            chunks = chunks.where(catalog.contains(own, metadata))
            vectors = vectors.join(chunks.select(F.col("chunk_id").alias("id")), "id", "left_semi")
        texts = chunks.select(F.col("chunk_id").alias("doc_id"), "text")
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        found = search.hybrid(self.spark, vectors, texts, self._embedded(asked), candidates=self.settings.candidates, k=self.settings.rrf_k)
        found = found.select("query_id", F.col("key").alias("id"), "score").join(texts.withColumnRenamed("doc_id", "id"), "id").select("query_id", "id", "text", "score").checkpoint()
        derived = asked.select(F.col("query_id").alias("of"), F.posexplode(Q.expansions(F.col("query"))).alias("n", "query")).select("of", (F.col("of") * 1000 + F.col("n")).alias("query_id"), "query").checkpoint()
        if not derived.isEmpty():
            per = max(12, self.settings.candidates // 5)
            extra = nearest(self.spark, vectors, self._embedded(derived), per).join(derived.select("query_id", "of"), "query_id")
            extra = extra.groupBy(F.col("of").alias("query_id"), "id").agg(F.max("score").alias("score")).join(texts.withColumnRenamed("doc_id", "id"), "id").select("query_id", "id", "text", "score")
            widened = derived.select(F.col("of").alias("query_id")).distinct()
            both = found.join(widened, "query_id", "left_semi")
            worded = search.expanded(both.join(asked, "query_id"), extra.join(asked, "query_id"), F.col("query"), F.lit(self.settings.candidates)).drop("rank")
            found = found.join(widened, "query_id", "left_anti").unionByName(worded)
        place = chunks.select(F.col("chunk_id").alias("id"), "asset_id", "file_name", "page", "chunk_order")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
        rows = found.join(asked, "query_id").join(place, "id").withColumn("rank", F.row_number().over(ranked))
        return rows.select("query_id", "query", "id", "text", "score", "rank", "asset_id", "file_name", "page", "chunk_order")

    def _embedded(self, asked: DataFrame) -> DataFrame:
        vectors = ingest.embedded(asked.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("chunk_text")), self.embedder)
        return vectors.select(F.col("chunk_id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), query_tokens(F.col("chunk_text")).alias("terms"))

    def set_prompt(self, user_id: str, project_id: int, prompt_en: str | None = None, prompt_ar: str | None = None) -> None:
        """The project's own wording of the prompt; what is None stays as it is."""
        self._owned(user_id, project_id)
        new = self.spark.range(1).select(F.lit(project_id).alias("prompt_id"), F.lit(project_id).alias("project_id"), F.lit(prompt_en).cast("string").alias("prompt_en"), F.lit(prompt_ar).cast("string").alias("prompt_ar"))
        self.own_prompts.change(new, lambda old: catalog.upsert(old, new, "project_id"))

    def prompt(self, user_id: str, project_id: int) -> dict[str, str | None]:
        self._owned(user_id, project_id)
        row = self.own_prompts.read(project_id).first()
        return {"en": row.prompt_en, "ar": row.prompt_ar} if row else {}

    def task_status(self, user_id: str, project_id: int) -> DataFrame:
        """All tasks of the store as they are now; for an owner of a project in it."""
        self._owned(user_id, project_id)
        return state.statuses(self._read("ledger", LEDGER))

    def process_and_push(self, user_id: str, project_id: int, path: str, *, reset: bool = False) -> int:
        """Process files, then embed what is new: how many vectors there are then. If the same files
        were done before, what is left to embed is embedded all the same."""
        self.process(user_id, project_id, path, reset=reset)
        return self.push(user_id, project_id)

    def file_totals(self, user_id: str, project_id: int) -> DataFrame:
        """(file_name, chunks, characters) of a project's files."""
        return catalog.file_totals(self.chunks(user_id, project_id), "file_name")

    def enriched(self, top: DataFrame, chunks: DataFrame) -> DataFrame:
        """(query_id, query, text, file_name, page, rank) of re-ranked rows and what goes with them:
        for structural questions runs of articles and chapters and other chunks of the pages, and for
        all the chunks that a found header announces. All of them by score; among equal ones those
        that were found come first, in their order."""
        keys = ["query_id", "asset_id", "chunk_order"]
        more = enrich.structural_context(top, chunks).select(*keys, "score")
        more = more.unionByName(enrich.continuations(top, chunks, needs_continuation(F.col("text"))).select(*keys, "score"))
        more = more.groupBy(*keys).agg(F.max("score").alias("score")).join(chunks.select("asset_id", "chunk_order", "text", "file_name", "page"), ["asset_id", "chunk_order"])
        more = more.join(top.select("query_id", "query").distinct(), "query_id").withColumn("found", F.lit(1 << 20))
        columns = ["query_id", "query", "text", "file_name", "page", "asset_id", "chunk_order", "score"]
        rows = top.select(*columns, F.col("rank").alias("found")).unionByName(more.select(*columns, "found"))
        place = Window.partitionBy("query_id").orderBy(F.desc("score"), "found", "asset_id", "chunk_order")
        return rows.withColumn("rank", F.row_number().over(place)).select("query_id", "query", "text", "file_name", "page", "rank")

    def answer(self, user_id: str, project_id: int, questions: list[str], session_id: str, metadata: dict[str, object] | None = None, *, mode: str = "auto") -> DataFrame:
        """(query_id, answer, asks): the questions with what is found for them, re-ranked, enriched and
        trimmed, put to the model together with the earlier messages that ``mode`` chooses (minimal,
        auto, user_only, full, of the session's last ones). Both sides are kept in the history."""
        found = self.search(user_id, project_id, questions, metadata)
        found = fusion.in_document_order(found, Q.is_structural(F.col("query"))).drop("rank").withColumnRenamed("prompt_rank", "rank")
        top = search.cross_encoded(found, self.reranker, chars=self.settings.rerank_chars, top=self.settings.rerank_top)
        top = top.withColumn("score", F.col("model_score").cast("double")).checkpoint()
        rows = self.enriched(top, self.chunks(user_id, project_id))
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        prompted = search.prompts(rows, self.settings.context_chars, own=self.prompt(user_id, project_id))
        out = search.answers(prompted, self.generator, self._said(user_id, project_id, asked, session_id, mode)).checkpoint()
        said = asked.select("query_id", F.lit("user").alias("role"), F.col("query").alias("text")).unionByName(out.where("answer is not null").select("query_id", F.lit("assistant").alias("role"), F.col("answer").alias("text")))
        now = F.lit(datetime.now(timezone.utc))
        message = identifier(F.lit(session_id), now, "query_id", "role")
        self.chats.append(
            said.select(message.alias("message_id"), message.cast("string").alias("message_uuid"), F.lit(session_id).alias("session_id"), F.lit(project_id).alias("project_id"), "role", F.struct("text").alias("content"), now.alias("created_at"))
        )
        return out

    def _said(self, user_id: str, project_id: int, asked: DataFrame, session_id: str, mode: str) -> DataFrame:
        """(query_id, place, role, text): the session's earlier messages for each question."""
        last = self.history(user_id, project_id, session_id).select("session_id", "place", "role", F.col("content.text").alias("text")).checkpoint()
        each = asked.select("query_id", F.lit(session_id).alias("session_id"), Q.is_follow_up(F.col("query")).alias("follow_up"))
        each = each.join(F.broadcast(last), "session_id")  # 20 rows at most
        return state.history(each, "query_id", "place", mode, F.col("follow_up")).select("query_id", "place", "role", "text")

    def clear_history(self, user_id: str, project_id: int, session_id: str) -> None:
        """Forget a session of a project."""
        self._owned(user_id, project_id)
        own = F.col("project_id") == project_id
        session = self.spark.range(1).select(F.lit(session_id).alias("session_id"))
        self.chats.change(session, lambda chat: chat.where(~F.coalesce(own, F.lit(False))).unionByName(state.cleared(chat.where(own), session_id)))

    def history(self, user_id: str, project_id: int, session_id: str, n: int = 20) -> DataFrame:
        self._owned(user_id, project_id)
        chat = self.chats.read(session_id).where(F.col("project_id") == project_id)
        return state.last_messages(chat, "session_id", "created_at", n)
