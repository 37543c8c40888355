"""The engine's calls, each a plan over tables: what an application asks for, with its defaults.

A Workspace has the tables of one collection. Files are never touched: renames, deletions and folders are returned as plans."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import wraps
from threading import Event, Lock, Thread, get_ident
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators import cache, cuts, groups, knn, linkage, naming, ordering, pairs, renames
from tessel.operators.history import GroupLog
from tessel.sources.stored import Store


class Busy(RuntimeError):
    """A job is running already."""


class MissingModel(RuntimeError):
    """A model that is asked for has no rows yet."""


@dataclass
class ClusterData:
    clusters: DataFrame
    labels: DataFrame
    steps: DataFrame
    suggested: DataFrame
    profile: DataFrame
    requested: int | None = None
    scope: dict | None = None


def _job(f: Callable) -> Callable:
    """What such a call runs while it makes its plan is one job; see Workspace.run for the job that runs the plan itself."""

    @wraps(f)
    def run(self: Workspace, *args, **kwargs):
        with self._guard(f.__name__):
            return f(self, *args, **kwargs)

    return run


@dataclass
class Workspace:
    """images: filename, pos, image_id; models: image_id, model, vec; members: group_id, name, group_pos, filename, image_id, member_pos; patches: image_id, patches; terms: term_pos, term, vec."""

    spark: SparkSession
    images: DataFrame
    models: DataFrame
    members: DataFrame
    patches: DataFrame | None = None
    terms: DataFrame | None = None
    store: Store | None = None
    extract: Callable[[str], DataFrame] | None = None
    fallback: str = "clip"
    job: str = "tessel"
    listeners: list[Callable[[str], None]] = field(default_factory=list)
    edits: GroupLog | None = None
    every: float = 0.5
    _lock: Lock = field(default_factory=Lock)
    _owner: int | None = None
    _group: str | None = None
    _cancelled: bool = False
    _models: tuple[DataFrame, list[str]] | None = None

    @contextmanager
    def _guard(self, name: str) -> Iterator[None]:
        """One job at a time, in a job group of its own that cancel() ends; jobs within a job of the same thread are part of it."""
        if self._owner == get_ident():
            yield
            return
        if not self._lock.acquire(blocking=False):
            raise Busy(name)
        sc = self.spark.sparkContext
        self._owner, self._group, self._cancelled = get_ident(), f"{self.job}-{uuid4().hex[:8]}", False
        over = Event()
        watcher = Thread(target=self._watch, args=(name, over), daemon=True)
        try:
            sc.setJobGroup(self._group, name, interruptOnCancel=True)
            self._tell(f"{name}: started")
            watcher.start()
            yield
            self._stop(over, watcher)
            self._tell(f"{name}: done")
        except BaseException:
            self._stop(over, watcher)
            self._tell(f"{name}: cancelled" if self._cancelled else f"{name}: failed")
            raise
        finally:
            sc._jsc.clearJobGroup()
            self._owner = self._group = None
            self._lock.release()

    def _stop(self, over: Event, watcher: Thread) -> None:
        over.set()
        if watcher.is_alive():
            watcher.join()

    def _watch(self, name: str, over: Event) -> None:
        """Tells the share of the job's tasks that are over whenever it has grown or a new Spark job has begun."""
        last: tuple[int, float] | None = None
        while not over.wait(self.every):
            now = self.progress()
            if now is not None and now != last:
                self._tell(f"{name}: job {now[0]}, {now[1]:.0%}")
                last = now

    def progress(self) -> tuple[int, float] | None:
        """(Spark jobs begun, share of the last one's tasks that are over) of the running job; None when nothing runs."""
        group, tracker = self._group, self.spark.sparkContext.statusTracker()
        jobs = sorted(tracker.getJobIdsForGroup(group)) if group else []
        if not jobs:
            return None
        info = tracker.getJobInfo(jobs[-1])
        stages = [x for s in (info.stageIds if info else []) if (x := tracker.getStageInfo(s)) is not None]
        total = sum(x.numTasks for x in stages)
        return len(jobs), sum(x.numCompletedTasks for x in stages) / total if total else 0.0

    def run(self, plan: DataFrame | Callable[[], DataFrame], sink: Callable[[DataFrame], object] = lambda df: df.toPandas(), name: str = "run") -> object:
        """Executes a plan (or what a call makes) as a job: while it runs another one is Busy and cancel() ends it. ``sink`` takes the rows, by default to pandas."""
        with self._guard(name):
            return sink(plan() if callable(plan) else plan)

    def _tell(self, what: str) -> None:
        for listener in self.listeners:
            listener(what)

    def cancel(self) -> None:
        if group := self._group:
            self._cancelled = True
            self.spark.sparkContext.cancelJobGroup(group)

    def running(self) -> bool:
        return self._lock.locked()

    # --- clusters

    def _known(self) -> list[str]:
        """The models that have rows; the table is asked once, as long as it is the same."""
        if self._models is None or self._models[0] is not self.models:
            self._models = self.models, sorted(r.model for r in self.models.select("model").distinct().collect())
        return self._models[1]

    def _vectors(self, weights: dict[str, float] | None) -> DataFrame:
        have = set(self._known())
        asked = {m: w for m, w in (weights or {self.fallback: 1.0}).items() if w and w > 0}
        if missing := sorted(set(asked) - have):
            if self.extract is None:
                raise MissingModel(", ".join(missing))
            for m in missing:  # once; what is still missing then is an error of the extraction
                self.models = self.models.unionByName(self.extract(m))
        return pairs.combined(self.models, asked)

    def _envelope(self, steps: DataFrame, items: DataFrame, labels: DataFrame, requested: int | None, scope: dict | None = None) -> ClusterData:
        n = items.count()
        held = items.where("group_pos IS NOT NULL").select("group_pos").distinct().count()
        rows = labels.join(items.select("idx", "image_id"), "idx").join(self.images, "image_id").select("image_id", "filename", "pos", "label")
        found = groups.from_labels(rows, self.members)
        if self.terms is not None:
            by_id = found.select("cluster_id", "label").join(rows, "label").select("cluster_id", "image_id")
            named = naming.auto_names(by_id, self.models.where(F.col("model") == self.fallback), self.terms, self._confirmed(found))
        else:
            named = naming.plain_names(found.select("cluster_id", F.col("cluster_id").alias("pos")).join(self._confirmed(found), "cluster_id", "left"))
        sizes = cuts.suggested_counts(self.spark.createDataFrame([(n,)], "n int"))
        return ClusterData(found.join(named, "cluster_id"), rows, steps, sizes, linkage.profile(steps, n, held), requested, scope)

    def _confirmed(self, found: DataFrame) -> DataFrame:
        names = self.members.groupBy("group_id").agg(F.first("name").alias("name"))
        return found.where("confirmed_group IS NOT NULL").join(names, found.confirmed_group == names.group_id).select("cluster_id", "name")

    @_job
    def cluster(self, n_clusters: int = 200, weights: dict[str, float] | None = None, use_patches: bool = False) -> ClusterData:
        """The full run. With patches only their distances count, as weights then have no effect."""
        return self._run(linkage.run_items, n_clusters, weights, use_patches)

    def _run(self, make: Callable, n_clusters: int, weights: dict | None, use_patches: bool, subset: DataFrame | None = None, name: str = "all", scope: dict | None = None, cut: Callable | None = None) -> ClusterData:
        if use_patches:
            if self.patches is None:
                raise MissingModel("patches")
            base = self.patches.select("image_id", F.lit(None).cast("array<double>").alias("vec"))
            items = make(base, self.members, name, subset)
            at = items.select("image_id", "idx")
            own = self.patches.join(at.select("image_id"), "image_id", "left_semi")
            d = pairs.patch_pairs(own).join(at.withColumnsRenamed({"image_id": "i", "idx": "x"}), "i").join(at.withColumnsRenamed({"image_id": "j", "idx": "y"}), "j")
            steps = linkage.linkages_of_pairs(items.drop("vec"), d.select(F.lit(name).alias("run_id"), F.col("x").alias("i"), F.col("y").alias("j"), "d"))
        else:
            items = make(self._vectors(weights), self.members, name, subset)
            steps = linkage.linkages(items)
        if self.store is not None:
            self.store.save(f"tree-{name}", steps)
            self.store.save(f"items-{name}", items.drop("vec"))
            steps, items = self.store.load(f"tree-{name}"), self.store.load(f"items-{name}")
        held = items.where("group_pos IS NOT NULL").select("group_pos").distinct().count()
        labels = cut(steps, items, held) if cut else cuts.by_count(steps, n_clusters, held)
        return self._envelope(steps, items, labels, n_clusters, scope)

    @_job
    def scoped_cluster(self, group_ids: list[str], n_clusters: int = 50, weights: dict[str, float] | None = None) -> ClusterData:
        """A run over the members of some groups only; the subset is taken before anything else."""
        files = groups.scope_members(self.members, group_ids, self.images)
        key = groups.scope_keys(self.spark.createDataFrame([("s", g) for g in set(group_ids)], "scope_id string, group_id string")).first().scope_key
        return self._run(linkage.run_items, n_clusters, weights, False, self.images.join(files, "filename", "left_semi"), f"scope-{key}", {"scope_key": key, "group_ids": sorted(group_ids)})

    def recut(self, n_clusters: int = 200, threshold: float | None = None, min_size: int | None = None) -> ClusterData:
        """Another cut of the saved run; distances aren't computed again."""
        return self._again("all", lambda s, i, g: cuts.recut(s, n_clusters, threshold, min_size, g), n_clusters)

    def scoped_recut(self, scope_key: str, n_clusters: int | None = None, threshold: float | None = None, min_size: int | None = None) -> ClusterData:
        return self._again(f"scope-{scope_key}", lambda s, i, g: cuts.scoped_recut(s, i.count(), n_clusters, threshold, min_size, g), n_clusters)

    def _again(self, name: str, cut: Callable, requested: int | None) -> ClusterData:
        steps = self.store.load(f"tree-{name}") if self.store else None
        if steps is None:
            raise LookupError(f"no saved run {name}")
        items = self.store.load(f"items-{name}")
        held = items.where("group_pos IS NOT NULL").select("group_pos").distinct().count()
        return self._envelope(steps, items, cut(steps, items, held), requested)

    @_job
    def compare(self, configs: dict[str, dict[str, float]], n_clusters: int = 200) -> DataFrame:
        """(run_id, idx, label, image_id) of several weight configurations, which are linked side by side."""
        runs = [linkage.run_items(self._vectors(w), self.members, name) for name, w in configs.items()]
        items = runs[0]
        for r in runs[1:]:
            items = items.unionByName(r)
        held = items.where("group_pos IS NOT NULL").select("group_pos").distinct().count()
        return cuts.by_count(linkage.linkages(items), n_clusters, held).join(items.select("run_id", "idx", "image_id"), ["run_id", "idx"])

    def import_clusters(self, found: DataFrame) -> DataFrame:
        """found (name, images) as clusters with the groups of their first grouped images, images sorted."""
        rows = found.select(F.monotonically_increasing_id().alias("label"), "name", F.explode(F.array_sort("images")).alias("filename")).join(self.images, "filename")
        names = rows.select("label", F.col("name").alias("auto_name")).distinct()
        out = groups.from_labels(rows.select("filename", "pos", "label"), self.members).join(names, "label")
        if self.store:
            self.store.save("imported", out)
        return out

    # --- similarity

    @_job
    def nearest(self, filenames: list[str], weights: dict[str, float] | None = None, **options) -> DataFrame:
        """(filename, distance, group_id, name); 50 results, by centroid, over any item unless said otherwise."""
        wanted = self.spark.createDataFrame([(f,) for f in dict.fromkeys(filenames)], "filename string").join(self.images, "filename").select("image_id")
        if options.pop("use_patches", False) and self.patches is not None:
            options["patches"] = self.patches
        got = knn.nearest(self.models, wanted, weights or {self.fallback: 1.0}, members=self.members, fallback=self.fallback, known_models=self._known(), **options)
        return got.join(self.images.select("image_id", "filename"), "image_id").orderBy("distance", "image_id").select("filename", "distance", "group_id", "name")

    @_job
    def merge_suggestions(self, threshold: float = 0.65, per_group: int = 8, max_size: int = 0) -> DataFrame:
        if self.patches is None:
            raise MissingModel("patches")
        make = lambda: pairs.group_similarity(self.members, self.patches, max_size)
        scores = self.store.cached("similarity", {"max_size": max_size}, [self.members, self.patches], make) if self.store else make()
        return pairs.merge_suggestions(scores, threshold, per_group, max_size, self.members)

    # --- plans

    def preview(self, order: DataFrame) -> DataFrame:
        return renames.rename_plan(order)

    def organize(self, numbered: bool = True) -> DataFrame:
        return renames.organize_plan(self.members, self.images, numbered)

    def order_on_disk(self) -> tuple[DataFrame, DataFrame]:
        return ordering.grouped_first_on_disk(self.images.select("filename"), self.members)

    def delete(self, names: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(outcome of each name, members afterwards)."""
        plan = renames.delete_split(names, self.images)
        return plan, groups.prune_deleted(self.members, plan.where("outcome = 'deleted'"))

    def edit(self, action: str, change: Callable[[DataFrame], DataFrame]) -> int:
        """Changes the groups by one of the operators in ``groups``, as a new version of the log."""
        if self.edits is None:
            raise LookupError("no log of edits")
        if self.edits.version() < 0:
            self.edits.commit(self.members, "start")
        version = self.edits.commit(change(self._logged()), action)
        self.members = self._logged()
        return version

    def undo_edit(self) -> int | None:
        """Takes back the last edit of the groups that isn't taken back yet, at most ten."""
        version = self.edits.undo() if self.edits else None
        if version is not None:
            self.members = self._logged()
        return version

    def _logged(self) -> DataFrame:
        return self.edits.as_of().join(self.images.select("filename", "image_id"), "filename", "left")

    def undo(self, mapping: DataFrame) -> DataFrame:
        return renames.undo_plan(mapping)

    def embeddings_status(self, files: DataFrame, rows: DataFrame, models: DataFrame) -> DataFrame:
        return cache.manifest(files, rows, models)
