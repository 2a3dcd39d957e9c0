"""Versioned snapshots of the graph tables: Parquet per version, a manifest, and a pointer swapped at once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FORMAT = 1
BUCKETS = 256


class Store:
    """Readers see one whole version; a version becomes visible when the pointer names it, and not before."""

    def __init__(self, spark: SparkSession, root: str, rules: str = "") -> None:
        self.spark, self.root, self.rules = spark, root.rstrip("/"), rules
        self._jvm = spark._jvm

    def _fs(self, path: str):
        place = self._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def _write(self, path: str, text: str) -> None:
        fs, place = self._fs(path + ".new")
        stream = fs.create(place, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        _, final = self._fs(path)
        jvm, conf = self._jvm, self.spark._jsc.hadoopConfiguration()
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(place, final, over)  # readers find the old or the new one

    def _read(self, path: str) -> str | None:
        fs, place = self._fs(path)
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def version(self) -> int:
        text = self._read(f"{self.root}/current")
        return int(text) if text else 0

    def publish(self, tables: dict[str, DataFrame], expected: int | None = None) -> int:
        """Writes the next version and points to it; with ``expected`` only if that is still the current one."""
        now = self.version()
        if expected is not None and now != expected:
            raise RuntimeError(f"version {now} was published meanwhile")
        new = now + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/v={new}/{name}")
        self._write(f"{self.root}/v={new}/manifest.json", json.dumps({"format": FORMAT, "rules": self.rules, "tables": {n: df.schema.jsonValue() for n, df in tables.items()}}))
        self._write(f"{self.root}/current", str(new))
        return new

    def replace_files(self, new: dict[str, DataFrame], gone: DataFrame, expected: int | None = None) -> int:
        """The next version, in which the rows of ``gone`` (file) are replaced by those of ``new`` tables (with a column file).

        Tables lie in ``BUCKETS`` parts by their file's hash. Only parts that hold a changed file are written, the manifest names
        for every part the version it was written by, so a small change costs as much as the parts it touches.
        """
        now = self.version()
        if expected is not None and now != expected:
            raise RuntimeError(f"version {now} was published meanwhile")
        version = now + 1
        manifest = self._manifest(now) if now else {"tables": {}}
        if now and "parts" not in manifest:
            raise ValueError("the snapshot wasn't written in parts")
        place = F.pmod(F.xxhash64("file"), F.lit(BUCKETS)).cast("int")
        gone = gone.select("file").distinct()
        parts = {n: dict(manifest.get("parts", {}).get(n, {})) for n in new}
        for name, fresh in new.items():
            both = gone.unionByName(fresh.select("file")).select(place.alias("p")).distinct()
            touched = sorted(r["p"] for r in both.collect())  # BUCKETS numbers at most
            old = [f"{self.root}/v={parts[name][str(p)]}/{name}/_part={p}" for p in touched if str(p) in parts[name]]
            rows = fresh
            if old:
                rows = self.spark.read.schema(fresh.schema).parquet(*old).join(gone, "file", "left_anti").select(fresh.columns).unionByName(fresh)
            rows.withColumn("_part", place).repartition("_part").write.mode("overwrite").partitionBy("_part").parquet(f"{self.root}/v={version}/{name}")
            for p in touched:
                fs, folder = self._fs(f"{self.root}/v={version}/{name}/_part={p}")
                parts[name].pop(str(p), None)
                if fs.exists(folder):
                    parts[name][str(p)] = version
        schemas = {n: df.schema.jsonValue() for n, df in new.items()}
        self._write(f"{self.root}/v={version}/manifest.json", json.dumps({"format": FORMAT, "rules": self.rules, "tables": schemas, "parts": parts}))
        self._write(f"{self.root}/current", str(version))
        return version

    def _manifest(self, version: int) -> dict:
        text = self._read(f"{self.root}/v={version}/manifest.json")
        if not version or text is None:
            raise FileNotFoundError("no snapshot")
        manifest = json.loads(text)
        if manifest["format"] != FORMAT or manifest["rules"] != self.rules:
            raise ValueError("the snapshot was made by another format or rule set")
        return manifest

    def load(self, version: int | None = None) -> dict[str, DataFrame]:
        """Tables of a version; one of another format or rule set is refused."""
        version = version or self.version()
        manifest = self._manifest(version)
        if "parts" not in manifest:
            return {n: self.spark.read.parquet(f"{self.root}/v={version}/{n}") for n in manifest["tables"]}
        out = {}
        for name, schema in manifest["tables"].items():
            told = StructType.fromJson(schema)
            paths = [f"{self.root}/v={v}/{name}/_part={p}" for p, v in sorted(manifest["parts"][name].items())]
            out[name] = self.spark.read.schema(told).parquet(*paths) if paths else self.spark.createDataFrame([], told)
        return out
