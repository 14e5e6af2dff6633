"""Portal configurations: YAML files with environment variables, read by Spark into a table."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Mapping

import pyarrow as pa
import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidflow.sources.settings import PORTALS, completed, section_faults

#: Builds the same values of JSON as the safe reader in Python.
FAST = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
VARIABLE = re.compile(r"\$\{([^}:]+)(?::-([^}]*))?\}")
#: Name, whether it is needed, type, least and most of the values that are checked.
CHECKS = [
    ("name", True, str, 1, 100), ("base_url", True, str, 1, 500), ("portal_type", False, str, 1, 50), ("enabled", False, bool, None, None), ("max_pages", False, int, 1, 1000), ("min_delay_ms", False, int, 0, None),
    ("max_delay_ms", False, int, 0, None), ("timeout_ms", False, int, 1, None), ("max_retries", False, int, 0, 20), ("confidence_threshold", False, float, 0, 1),
]


def expanded(value, env: Mapping[str, str] | None = None):
    """value with ``${NAME}`` and ``${NAME:-default}`` in its texts replaced; unset without a default: empty."""
    env = os.environ if env is None else env
    if isinstance(value, str):
        return VARIABLE.sub(lambda m: env.get(m[1], m[2] or ""), value)
    if isinstance(value, dict):
        return {k: expanded(v, env) for k, v in value.items()}
    return [expanded(v, env) for v in value] if isinstance(value, list) else value


def faults(config) -> list[str]:
    """What is wrong with a configuration, as ``place: message``."""
    if not isinstance(config, dict):
        return ["document: not a mapping"]
    found = []
    for name, needed, kind, low, high in CHECKS:
        value = config.get(name)
        if value is None:
            found += [f"{name}: is missing"] if needed else []
        elif not isinstance(value, (int, float) if kind is float else kind) or kind is not bool and isinstance(value, bool):
            found.append(f"{name}: is no {kind.__name__}")
        elif kind is not bool:
            size = len(value) if kind is str else value
            if low is not None and size < low or high is not None and size > high:
                found.append(f"{name}: is not within {low} and {high}")
    if config.get("portal_type", "generic_table") not in PORTALS:
        found.append("portal_type: is unknown")
    low, high = config.get("min_delay_ms"), config.get("max_delay_ms")
    if isinstance(low, int) and isinstance(high, int) and high < low:
        found.append("max_delay_ms: is less than min_delay_ms")
    return found + [f for f in section_faults(config, False) if f.partition(": ")[0].partition(".")[2]]  # top-level values are checked above


def read(text: str):
    """A YAML document. What is JSON as well, without tabs, is read by libyaml, which is several times faster; elsewhere that takes some texts that PyYAML's own reader refuses (after a tab, for one), which so has the word."""
    try:
        if "\t" in text:
            raise ValueError
        json.loads(text)
        return yaml.load(text, Loader=FAST)
    except (ValueError, RecursionError, yaml.YAMLError):
        return yaml.safe_load(text)


def loaded(text: str, env: Mapping[str, str] | None = None) -> dict:
    """A YAML document with its variables; none at all is an empty mapping."""
    return expanded(read(text) or {}, env)


def portal_configs(spark: SparkSession, folder: str, env: Mapping[str, str] | None = None) -> DataFrame:
    """One row for each configuration (*.yaml, then *.yml) of a folder; of equal names the later file counts.

    config_hash, the first 16 digits of the SHA-256 of the file, tells whether it changed; settings is the whole
    configuration as JSON, with what stands for missing values.
    """
    files = spark.read.format("binaryFile").load(folder).where(F.col("path").rlike(r"/[^_/][^/]*\.ya?ml$")).select("path", "content")

    def run(batches):
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    config = loaded(content.decode("utf-8"), env)
                    wrong = faults(config)
                except (yaml.YAMLError, UnicodeDecodeError) as e:
                    config, wrong = {}, [f"document: {type(e).__name__}"]
                config = config if isinstance(config, dict) else {}
                text = lambda k, default=None, config=config: default if config.get(k) is None else str(config[k])
                out.append((path, text("name"), text("display_name"), text("base_url"), text("portal_type", "generic_table"), bool(config.get("enabled", True)), hashlib.sha256(content).hexdigest()[:16], wrong, json.dumps(completed(config), default=str) if config else None))
            kinds = [pa.string()] * 5 + [pa.bool_(), pa.string(), pa.list_(pa.string()), pa.string()]
            names = ["path", "portal_name", "display_name", "base_url", "portal_type", "enabled", "config_hash", "faults", "settings"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [[]] * 9, kinds)], names=names)

    found = files.mapInArrow(run, "path string, portal_name string, display_name string, base_url string, portal_type string, enabled boolean, config_hash string, faults array<string>, settings string")
    last = F.max_by(F.struct(*found.columns), F.struct(F.col("path").endswith(".yml"), "path"))
    named = found.where("portal_name is not null").groupBy(F.col("portal_name").alias("n")).agg(last.alias("r")).select("r.*")
    return named.unionByName(found.where("portal_name is null"))


def synced(portals: DataFrame, configs: DataFrame) -> DataFrame:
    """portals (portal_name, base_url, config_hash) after the configurations, with what became of each: created, updated, unchanged or absent."""
    new = configs.where(F.size("faults") == 0).select("portal_name", F.col("base_url").alias("__url"), F.col("config_hash").alias("__hash"))
    both = portals.join(new, "portal_name", "full")
    outcome = F.when(F.col("__hash").isNull(), "absent").when(F.col("config_hash").isNull(), "created").when(F.col("config_hash") == F.col("__hash"), "unchanged").otherwise("updated")
    return both.select("portal_name", F.coalesce("__url", "base_url").alias("base_url"), F.coalesce("__hash", "config_hash").alias("config_hash"), outcome.alias("outcome"))


def checked(documents: DataFrame, id_col: str, text_col: str, env: Mapping[str, str] | None = None) -> DataFrame:
    """(id, faults, settings) of configurations told as texts: all that is wrong, and the whole configuration as JSON (null if it can't be read)."""

    def told(text: str | None) -> tuple[list[str], str | None]:
        try:
            config = loaded(text or "", env)
        except yaml.YAMLError as e:
            return [f"document: {type(e).__name__}"], None
        if not isinstance(config, dict):
            return ["document: not a mapping"], None
        return section_faults(config), json.dumps(completed(config), default=str)

    def run(batches):
        for batch in batches:
            found = [told(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([f for f, _ in found], pa.list_(pa.string())), pa.array([s for _, s in found], pa.string())], names=["id", "faults", "settings"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, faults array<string>, settings string")


def chosen(configs: DataFrame, name: str | None = None, every: bool = False) -> DataFrame:
    """The configurations of a run: that of one portal, or all of them, disabled ones too; one of both has to be asked for."""
    if (name is None) == (not every):
        raise ValueError("name one portal, or all")
    return configs if every else configs.where(F.col("portal_name") == name)
