"""A workspace: one project's facts, kept as tables in a folder, analysed again only where files changed.

`analyze` reads sources, configuration and libraries, parses new and changed files, drops the facts of what they replace,
and solves again from the facts; where nothing changed nothing is solved. Results are Parquet tables under `location`.
Every table is written to a folder of its own, and one pointer file, replaced as the last step, says which folders are
current: readers see all of an analysis or all of the one before, also where a run stops half way.
"""

from __future__ import annotations

import json
import uuid
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factflow.cluster import ship
from factflow.operators import callgraph, closure, collections, hierarchy, incremental, lineage, pointsto, spring
from factflow.sources import classfile, config, java, maven

#: Tables of another version are not read: everything is analysed again.
VERSION = 2
RESULTS = ["facts", "files", "configuration", "libraries", "library_facts", "properties", "points_to_sets", "call_edges", "lineage_edges", "web_routes"]


class NotFound(ValueError):
    """There is no such workspace, or it has not been analysed."""


class Workspace:
    """`libraries`: folders with class and jar files; `repository`: a local Maven repository, from which the jars of the
    project's own dependencies are taken too (poms are read where this runs, so the project must then be a local folder)."""

    def __init__(self, spark: SparkSession, location: str, project: str, libraries: list[str] | None = None, repository: str | None = None):
        if not location or not project:
            raise ValueError("location and project must not be empty")
        self.spark, self.location, self.project, self.status = spark, location.rstrip("/"), project, "unloaded"
        self.libraries, self.repository, self._new = list(libraries or []), repository, {}
        ship(spark)

    # --- tables
    def _files(self):
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.location).getFileSystem(conf)

    def _pointer(self) -> dict:
        path, fs = self._files()
        if not fs.exists(path(f"{self.location}/current")):
            return {}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.location}/current").collect()))

    def table(self, name: str) -> DataFrame:
        folder = self._new.get(name) or self._pointer().get("tables", {}).get(name)
        if folder is None:
            raise NotFound(f"{self.location} has no {name}")
        return self.spark.read.parquet(f"{self.location}/{folder}")

    def _save(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table of the analysis that is under way; it becomes current with the others."""
        folder = f"{name}/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.location}/{folder}")
        self._new[name] = folder
        return self.table(name)

    def _commit(self, before: dict) -> None:
        """Make the new tables current by one rename, then remove those that neither this analysis nor the last one has."""
        path, fs = self._files()
        now = {"version": VERSION, "tables": before.get("tables", {}) | self._new, "previous": before.get("tables", {})}
        staged = f"{self.location}/_staged-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.text(staged)
        part = next(f.getPath() for f in fs.listStatus(path(staged)) if f.getPath().getName().startswith("part-"))
        jvm = self.spark._jvm
        options = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), fs.getConf())
        context.rename(part, fs.makeQualified(path(f"{self.location}/current")), options)
        fs.delete(path(staged), True)
        for folder in set(before.get("previous", {}).values()) - set(now["tables"].values()) - set(now["previous"].values()):
            fs.delete(path(f"{self.location}/{folder}"), True)
        self._new = {}

    # --- analysis
    def analyze(self) -> dict[str, int]:
        """Bring all tables up to date; returns how many files were new, dirty, deleted and same."""
        spark, before = self.spark, self._pointer()
        if before.get("version") != VERSION:
            before = {}  # tables of another version are not read
        keep, self._new = bool(before), {}
        sources = java.java_files(spark, self.project).withColumn("hash", F.sha2("content", 256))
        now = sources.select(F.col("path").alias("file_path"), "hash")
        settings = config.config_files(spark, self.project).select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("hash"))
        library = self._library_files()
        jars = library.select(F.col("path").alias("file_path"), F.col("content_hash").alias("hash"))
        old = self.table("files") if keep else now.limit(0)
        diff = incremental.snapshot_diff(old, now).cache()
        counts = {k: 0 for k in ("new", "dirty", "deleted", "same")} | {r.status: r["count"] for r in diff.groupBy("status").count().collect()}
        changed = any(counts[k] for k in ("new", "dirty", "deleted"))
        if keep and not changed and not incremental.config_changed(self.table("configuration"), settings) and not incremental.config_changed(self.table("libraries"), jars):
            diff.unpersist()
            self.status = "loaded"
            return counts
        if changed or not keep:
            fresh = sources.join(diff.where("status in ('new', 'dirty')").select(F.col("file_path").alias("path")), "path", "left_semi")
            tagged = java.facts(fresh)
            if keep:
                # facts bear their file: those of changed and deleted files go, whatever classes they belong to
                tagged = self.table("facts").join(diff.where("status = 'same'"), "file_path", "left_semi").unionByName(tagged)
            self._save(tagged, "facts")
            self._save(now, "files")
        # a library is read once for its content, whatever it is called and wherever it lies
        self._save(classfile.facts(library, self.table("library_facts") if keep else None), "library_facts")
        self._save(settings, "configuration")
        self._save(jars, "libraries")
        self._solve(self.table("facts"), self.table("library_facts"))
        self._commit(before)
        self.status = "loaded"
        diff.unpersist()
        return counts

    def _library_files(self) -> DataFrame:
        found = [classfile.files(self.spark, p) for p in self.libraries]
        if self.repository:
            poms = sorted(Path(urlparse(self.project).path).rglob("pom.xml"))
            jars = sorted({f"file://{j}" for p in poms if not set(p.parts) & set(java.SKIPPED_DIRS) for j in maven.jars(p, Path(urlparse(self.repository).path))})
            found += [classfile.files(self.spark, j) for j in jars]
        if not found:
            return self.spark.createDataFrame([], "content_hash string, path string, content binary")
        return closure.union(found).dropDuplicates(["content_hash"])

    def _wiring(self, get, properties: DataFrame, ann: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Objects and assignments that dependency injection adds: beans, injected fields and parameters, values."""
        declarations, beans = get("method_declarations"), spring.beans(get("class_annotations"))
        anc = hierarchy.ancestors(get("class_hierarchy"), only=beans)
        bean_alloc, bean_flow = spring.bean_allocations(beans, declarations)
        starting = lambda df, name, out: df.where(F.startswith("annotation_name", F.lit(f"{name}:"))).withColumn(out, F.substring("annotation_name", len(name) + 2, 1 << 20)).drop("annotation_name")
        wired = ann.where(F.substring_index("annotation_name", ":", 1).isin("Autowired", "Resource", "Inject")).select("class_fqn", "field_name").distinct()
        fields = wired.join(starting(ann, "FieldType", "type"), ["class_fqn", "field_name"]).join(starting(ann, "Qualifier", "qualifier"), ["class_fqn", "field_name"], "left")
        found = spring.candidates(fields.select(F.col("class_fqn").alias("owner"), F.col("field_name").alias("field"), "type", "qualifier"), beans, anc)
        # constructors and annotated methods of beans take their parameters from beans, but for those that take a value
        marks = get("parameter_annotations")
        asked = get("method_annotations").where(F.substring_index("annotation_name", ":", 1).isin("Autowired", "Inject", "Bean")).select("method_fqn")
        points = spring.parameter_points(declarations.join(beans.select("class_fqn"), "class_fqn", "left_semi"), asked)
        owner = lambda df: df.withColumnsRenamed({"method_fqn": "owner", "parameter_name": "field"})
        valued = owner(starting(marks, "Value", "value"))
        free = points.join(valued, ["owner", "field"], "left_anti").join(owner(starting(marks, "Qualifier", "qualifier")), ["owner", "field"], "left")
        into = spring.candidates(free.select("owner", "field", "type", "qualifier"), beans, anc).join(points.select("owner", "field", "position"), ["owner", "field"])
        field_values = spring.resolve_values(starting(ann, "Value", "value").select(F.concat(F.lit("SpringBeanAlloc:"), "class_fqn", F.lit("."), "field_name").alias("lhs"), "value"), properties)
        at = spring.every_parameter(declarations)
        parameter_values = spring.resolve_values(valued.join(at, ["owner", "field"]).select(F.concat("owner", F.lit("#p"), F.col("position").cast("string")).alias("lhs"), "value"), properties)
        resolved = field_values.unionByName(parameter_values)
        value_flow = resolved.select("lhs", F.concat(F.lit("StringAlloc:"), "resolved").alias("rhs"), F.lit("ALLOC").alias("assignment_type"), F.lit("SpringDI").alias("method_fqn"))
        flows = bean_flow.unionByName(spring.injections(found)).unionByName(spring.parameter_injections(into)).unionByName(value_flow)
        return bean_alloc.unionByName(spring.value_allocations(resolved)), flows

    def _solve(self, facts: DataFrame, library: DataFrame) -> None:
        spark, get = self.spark, lambda n: java.relation(facts, n)
        lib = lambda n: classfile.relation(library, n)
        properties = self._save(config.resolved(config.entries(config.config_files(spark, self.project))), "properties")
        objects, flows = self._wiring(get, properties, get("field_annotations"))
        allocations = get("allocation_sites").unionByName(objects).groupBy("alloc_id").agg(F.min_by("class_fqn", "class_fqn").alias("class_fqn"), F.min("method_fqn").alias("method_fqn"))
        types = get("variable_types")
        modelled = collections.model(get("call_sites"), get("call_arguments"), types.select(F.col("var").alias("receiver"), "type"))
        assignments = get("source_assignments").unionByName(flows).unionByName(modelled)
        # of a library's methods the solver knows what they hand on; their bodies are not entered
        declared = get("method_declarations").unionByName(lib("method_declarations")).distinct()
        parents = get("class_hierarchy").unionByName(lib("class_hierarchy")).distinct()
        f = pointsto.Facts(
            parents, declared, allocations, assignments, get("call_sites"), get("call_arguments"), lib("method_summaries"), method_annotations=get("method_annotations"), variable_types=types
        )
        solution = pointsto.solve(spark, f)
        self._save(solution.pts.unionByName(pointsto.field_expressions(solution, assignments)).distinct(), "points_to_sets")
        edges = self._save(solution.call_edges(), "call_edges")
        flow = lineage.intra(assignments).unionByName(lineage.inter(get("call_sites"), get("call_arguments"), edges, declared))
        self._save(lineage.contracted(flow.where("from_node is not null and to_node is not null")), "lineage_edges")
        self._save(spring.routes_of_annotations(get("class_annotations"), get("method_annotations")), "web_routes")

    # --- queries
    def call_graph(self, method: str, direction: str = "outgoing") -> DataFrame:
        return callgraph.query(self.table("call_edges"), method, direction)

    def lineage(self, node: str, direction: str = "downstream") -> tuple[DataFrame, DataFrame]:
        return lineage.query(self.table("lineage_edges"), node, direction)

    def routes(self, path: str | None = None, http_method: str | None = None) -> DataFrame:
        return callgraph.routes(self.table("web_routes"), path, http_method)

    def remove(self) -> None:
        """Delete all tables."""
        path, fs = self._files()
        fs.delete(path(self.location), True)
        self.status = "unloaded"

    def stop(self) -> None:
        """Let go of cached rows; tables stay, and the next query reads them."""
        self.status = "idle"
