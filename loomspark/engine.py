"""The library's face: one vault, one index, and the queries over them."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark import VERSION
from loomspark.functions.text import FrontmatterError, parse_note, word_count
from loomspark.operators import activity, blockmax, gaps, golden, graph, lexical, refresh, vector
from loomspark.operators import neighbors as walk
from loomspark.operators import search as hybrid
from loomspark.operators.embed import Embedder, HashingEmbedder
from loomspark.operators.fusion import Fusion, fuse_batch
from loomspark.plans import index
from loomspark.policy import Policy
from loomspark.sources import files, gitlog, vault
from loomspark.sources.store import IndexCorruptionError, IndexIdentityError, IndexStore

REMEDY = {"unavailable": "Retry when the files can be read and nothing writes to them."}


@dataclass(frozen=True)
class SearchHit:
    chunk_id: str
    note_path: str
    heading: str | None
    score: float
    snippet: str


@dataclass(frozen=True)
class Neighbor:
    note_path: str
    depth: int
    via: str
    direction: str
    tokens: int
    included: bool
    content: str | None


@dataclass(frozen=True)
class Neighborhood:
    origin: str
    context: str
    neighbors: tuple[Neighbor, ...]


@dataclass(frozen=True)
class ActivityEntry:
    note_path: str
    modified: str
    first_line: str


class Engine:
    def __init__(self, spark: SparkSession, policy: Policy, embedder: Embedder | None = None, store: IndexStore | None = None):
        self.spark, self.policy = spark, policy
        self.embedder = embedder or HashingEmbedder()
        self.store = store or IndexStore(policy.index_dir)

    def _table(self, name: str, now: dict | None = None) -> DataFrame:
        return self.store.read(self.spark, name, now)

    def _seen(self, listed: DataFrame | None = None) -> DataFrame:
        """note_path of all that may be seen, by one listing of the vault on the executors."""
        return vault.gate(vault.listing(self.spark, self.policy) if listed is None else listed, self.policy)

    # ------------------------------------------------------------ index

    def index(self, force: bool = False) -> index.RefreshReport:
        return index.refresh(self.spark, self.policy, self.store, self.embedder, force)

    # ------------------------------------------------------------ search

    def search(self, query: str, k: int = hybrid.DEFAULT_K, fusion: Fusion = Fusion.RRF) -> list[SearchHit]:
        self.index()
        return self.search_built(query, k, fusion)

    def search_built(self, query: str, k: int, fusion: Fusion) -> list[SearchHit]:
        """Without a refresh. The pool is cut first and gated then, so the result may be short."""
        k = hybrid.clamp(k)
        if not k:
            return []
        now = self.store.current()
        chunks = self._table("chunks", now)
        limit = k * hybrid.OVERFETCH
        legs = [vector.cosine_leg(chunks, self.embedder.embed([query])[0].tolist(), limit), blockmax.Postings(self._table("postings", now), *self.store.statistics(now)).leg(query, limit)]
        pool = hybrid.fuse(legs, fusion)
        rows = chunks.join(F.broadcast(pool), "chunk_id").orderBy(F.desc("score"), "chunk_id").collect()  # two limits at most
        allowed = set(vault.visible(sorted({r["note_path"] for r in rows}), self.policy))
        return [SearchHit(r["chunk_id"], r["note_path"], r["heading"], r["score"], r["text"]) for r in rows if r["note_path"] in allowed][:k]

    def search_notes(self, query: str, k: int, fusion: Fusion = Fusion.RRF) -> list[str]:
        return list(dict.fromkeys(h.note_path for h in self.search_built(query, k, fusion)))

    def read(self, path: str) -> str:
        return vault.read_note(path, self.policy)

    def similar_notes(self, path: str, k: int = hybrid.DEFAULT_K) -> list[tuple[str, float]]:
        vault.resolve(path, self.policy)
        k = hybrid.clamp(k)
        pooled = vector.pooled_vectors(self._table("chunks"))
        origin = self.spark.createDataFrame([(path,)], "note_path string")
        best = vector.similar_notes(pooled, origin, max(1, k), self._seen()).orderBy("rank")
        return [(r["other"], r["score"]) for r in best.collect()][:k]

    # ------------------------------------------------------------ graph

    def edges(self, listed: DataFrame | None = None) -> DataFrame:
        """Links between all notes of the vault as they are now; only notes that the index doesn't know are read, on the executors."""
        notes = vault.notes_of(vault.listing(self.spark, self.policy) if listed is None else listed, self.policy)
        return index.edges_now(self.spark, self.policy, self.store, notes).persist()

    def neighbors(self, path: str, depth: int = 1, token_budget: int = walk.DEFAULT_BUDGET) -> Neighborhood:
        real = vault.resolve(path, self.policy).relative_to(self.policy.vault_root.resolve()).as_posix()
        listed = vault.listing(self.spark, self.policy)
        edges = self.edges(listed)
        found = walk.neighbors(edges, self.spark.createDataFrame([(real,)], "node string"), depth, self._seen(listed).select(F.col("note_path").alias("node")))
        texts = vault.contents(found.withColumnRenamed("node", "note_path"), self.policy).withColumn("content", F.decode("content", "UTF-8"))
        framed = texts.withColumnRenamed("note_path", "node").withColumn("tokens", word_count(F.col("content")))
        kept = walk.with_budget(framed, token_budget)
        kept = kept.withColumn("content", F.when(F.col("included"), F.col("content"))).orderBy("rank").collect()  # texts within the budget
        edges.unpersist()
        out = tuple(Neighbor(*(r[c] for c in ("node", "depth", "via", "direction", "tokens", "included", "content"))) for r in kept)
        return Neighborhood(path, self.policy.active_context(), out)

    def gaps(self, threshold: float = gaps.THRESHOLD, max_score: float = gaps.MAX_SCORE, k: int = gaps.K, hub_degree: int = gaps.HUB_DEGREE, dismissals: str = files.DISMISSALS) -> list[tuple[str, str, float]]:
        if self.store.current() is None:
            raise FileNotFoundError(f"no index in {self.store.index_dir}")
        listed = vault.listing(self.spark, self.policy)
        edges, seen = self.edges(listed), self._seen(listed)
        pooled = vector.pooled_vectors(self._table("chunks")).cache()
        similar = vector.similar_notes(pooled, seen, max(1, hybrid.clamp(k)), seen)
        raw = vault.contents(seen, self.policy).select("note_path", F.sha1("content").alias("sha1"))
        dismissed = gaps.active_dismissals(files.DismissalStore(self.policy.vault_root, dismissals).frame(self.spark), raw)
        degree = graph.degrees(vault.notes_of(listed, self.policy).select(F.col("note_path").alias("node")), edges)
        ranked = gaps.rank_pairs(similar, edges, degree, dismissed, threshold, max_score, hub_degree)
        out = [(r["a"], r["b"], r["score"]) for r in ranked.orderBy("rank").collect()]
        for frame in (edges, pooled):
            frame.unpersist()
        return out

    def dismiss(self, a: str, b: str, path: str = files.DISMISSALS) -> None:
        files.DismissalStore(self.policy.vault_root, path).add(a, b)

    # ------------------------------------------------------------ activity, golden, status

    def recent_activity(self, days: int = activity.DEFAULT_DAYS, limit: int = activity.DEFAULT_LIMIT, now: datetime | None = None) -> list[ActivityEntry]:
        if days <= 0 or limit <= 0:
            return []
        now = (now or datetime.now(UTC)).replace(microsecond=0)
        since = now - timedelta(days=days)
        commits, tree = gitlog.changes(self.spark, self.policy, since)
        changed = activity.latest_change(commits, tree, F.lit(since))
        out = []
        for r in activity.recent_activity(changed, self._seen(), F.lit(now), days, limit).orderBy("rank").collect():  # 50 at most
            try:
                body = parse_note(self.read(r["note_path"]))[1]
            except FrontmatterError:
                body = ""
            out.append(ActivityEntry(r["note_path"], r["modified"], next((x for x in body.splitlines() if x.strip()), "")))
        commits.unpersist()
        return out

    def golden(self, queries: list[files.GoldenQuery], fusion: Fusion = Fusion.RRF) -> files.GoldenReport:
        """All queries of one k in one plan, with the pool and the gate of ``search_built``."""
        if not queries:
            return files.GoldenReport((), 0.0)
        now = self.store.current()
        chunks, post, seen = self._table("chunks", now), blockmax.flat(self._table("postings", now)).drop("len"), self._seen()
        hits = []
        for k in sorted({hybrid.clamp(q.k) for q in queries}):
            own = [(str(i), q.text) for i, q in enumerate(queries) if hybrid.clamp(q.k) == k]
            vectors = [(i, v.tolist()) for (i, _), v in zip(own, self.embedder.embed([text for _, text in own]))]
            legs = [
                vector.cosine_batch(chunks, self.spark.createDataFrame(vectors, "query_id string, vector array<double>"), k * hybrid.OVERFETCH),
                lexical.bm25_batch(post, self._table("doc_len", now), self.spark.createDataFrame(own, "query_id string, text string"), k * hybrid.OVERFETCH),
            ]
            pool = chunks.select("chunk_id", "note_path").join(fuse_batch(legs, fusion), "chunk_id").join(seen, "note_path", "left_semi")
            place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
            hits.append(pool.select(F.col("query_id").alias("query"), "note_path", place.alias("rank")))
        wanted = self.spark.createDataFrame([(str(i), list(q.expect), hybrid.clamp(q.k)) for i, q in enumerate(queries)], "query string, expect array<string>, k int")
        rows = golden.evaluate(wanted, reduce(DataFrame.unionByName, hits)).persist()
        mean = golden.mean_recall(rows).first()["mean_recall"]
        out = [files.GoldenRow(queries[int(r["query"])].text, r["recall"], tuple(r["found"]), tuple(r["missed"])) for r in rows.orderBy(F.col("query").cast("int")).collect()]
        rows.unpersist()
        return files.GoldenReport(tuple(out), mean)

    def provenance(self, path: str | Path, queries: list[files.GoldenQuery], fusion: Fusion = Fusion.RRF) -> files.GoldenProvenance:
        """What a report was measured against."""
        own = self.embedder.identity
        revision, changed = gitlog.revision(self.policy)
        return files.GoldenProvenance(
            oracle_path=str(path), oracle_sha256=hashlib.sha256(Path(path).read_bytes()).hexdigest(), query_count=len(queries), vault_revision=revision, vault_dirty=changed,
            note_count=self._table("notes").count(), chunk_count=self.store.current()["chunks"], model_name=own.name, model_dim=own.dim, model_version=own.version, fusion=Fusion(fusion).value, engine_version=VERSION,
        )

    def diff(self, baseline: files.GoldenReport, current: files.GoldenReport) -> list[dict]:
        frames = [self.spark.createDataFrame([(i, r.query, r.recall) for i, r in enumerate(x.rows)], "position int, query string, recall double") for x in (baseline, current)]
        return [r.asDict() for r in golden.diff(*frames).orderBy("position").drop("position").collect()]

    def status(self) -> dict:
        """What the index is worth just now, without changing anything."""
        out = {"vault_root": str(self.policy.vault_root.resolve()), "index_dir": self.store.index_dir, "model": self.embedder.identity.name, "recorded_identity": None, "notes": 0, "chunks": 0}
        out |= dict.fromkeys(("stale_notes", "added_notes", "changed_notes", "deleted_notes", "index_built_at")) | {"root_provenance": "not_recorded", "ready": False, "state": "missing"}

        def failed(state: str, error: str) -> dict:
            gone = dict.fromkeys(("notes", "chunks", "stale_notes", "added_notes", "changed_notes", "deleted_notes"))
            return out | gone | {"state": state, "ready": False, "error": error, "remediation": REMEDY.get(state, "index --force")}

        try:
            if not self.policy.vault_root.is_dir():
                raise vault.Unavailable("the vault root isn't a folder that can be read")
            now = self.store.current()
            if now is None:
                return failed("corrupt", "tables exist without a manifest") if self.store.folder().names("data") else out
            if not now.get("identity"):
                return out | {"state": "unbuilt"}
            self.store.check_identity(self.embedder.identity)
            self.store.validate(self.spark)
            with vault.steady(self.spark, self.policy) as walked:
                live = vault.contents(walked, self.policy).select("note_path", F.sha2("content", 256).alias("sha256"))
                s = refresh.staleness(self._table("notes"), live).first()
            done = {"recorded_identity": now["identity"], "notes": self._table("notes").count(), "chunks": now["chunks"]}
            return out | done | {"added_notes": s["added"], "changed_notes": s["changed"], "deleted_notes": s["deleted"], "stale_notes": s["stale"], "state": s["state"], "ready": s["state"] == "ready"}
        except IndexIdentityError as e:
            return failed("identity_mismatch", str(e))
        except IndexCorruptionError as e:
            return failed("corrupt", f"the index can't be verified: {e}")
        except (vault.Unavailable, OSError) as e:
            return failed("unavailable", str(e))


__all__ = ["ActivityEntry", "Engine", "Neighbor", "Neighborhood", "SearchHit"]
