"""Contracts of cases, evidence, hierarchies, models and their runtimes.

Checks of tables give rows of violations; checks of one file, session or
document of numbers run on the driver and give a list of what is wrong.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .governance import ContractViolation
from .sufficiency import FEATURES, Model

EVIDENCE_FIELDS = ("document_id", "label", "citation_text")
#: What a node that no heading stands for must not have.
PROVENANCE = ("heading_id", "page_id", "page_number", "start_line_number", "end_line_number")


def require(problems: Iterable[str], name: str) -> None:
    """Raise if there is any problem."""
    found = list(problems)
    if found:
        raise ContractViolation(f"{name}: " + "; ".join(found))


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (T.strip(F.col(c).cast("string")) == "")


def evidence_violations(evidence: DataFrame, passages: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """case_id, passage_id and rule where cited evidence isn't the accepted passage, field by field.

    ``evidence`` has case_id, passage_id and the fields, ``passages``
    passage_id and the same fields. With ``cases``, those without evidence
    are listed too.
    """
    known = passages.select("passage_id", *[F.col(c).alias(f"_{c}") for c in EVIDENCE_FIELDS], F.lit(True).alias("_known"))
    rows = evidence.join(known, "passage_id", "left")
    differs = [F.when(_blank(c), F.lit(f"{c} blank")).when(F.col("_known") & ~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(f"{c} differs")) for c in EVIDENCE_FIELDS]
    unknown = F.when(_blank("passage_id"), "no passage").when(F.col("_known").isNull(), "no such passage")
    out = rows.select("case_id", "passage_id", F.explode(F.array_compact(F.array(unknown, *differs))).alias("rule"))
    out = out.union(evidence.groupBy("case_id", "passage_id").count().where("count > 1").select("case_id", "passage_id", F.lit("cited twice")))
    if cases is not None:
        bare = cases.select("case_id").join(evidence.select("case_id"), "case_id", "left_anti")
        out = out.union(bare.select("case_id", F.lit(None).cast(out.schema["passage_id"].dataType), F.lit("no evidence")))
    return out


def heading_node_violations(nodes: DataFrame, headings: DataFrame) -> DataFrame:
    """id and rule where source nodes and headings don't stand one to one.

    ``nodes`` has node_id, node_kind, depth (from 1) and ``PROVENANCE``;
    ``headings`` heading_id. Ids are those of nodes, or of headings where a
    rule is about one.
    """
    source, made = F.col("node_kind") == "source", F.col("node_kind") == "synthetic"
    rules = [
        F.when(_blank("node_id"), "no id"), F.when(F.col("node_kind").isNull() | ~(source | made), "kind"), F.when(F.col("depth").isNull() | (F.col("depth") < 1), "depth"), F.when(source & _blank("heading_id"), "no heading"),
        *[F.when(made & F.col(c).isNotNull(), f"synthetic with {c}") for c in PROVENANCE],
    ]
    out = nodes.select(F.col("node_id").alias("id"), F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    of_heading = nodes.where(source & ~_blank("heading_id")).groupBy(F.col("heading_id").alias("id")).agg(F.count("*").alias("n"))
    listed = headings.groupBy(F.col("heading_id").alias("id")).agg(F.count("*").alias("m"))
    both = of_heading.join(listed, "id", "full_outer")
    rule = F.array(F.when(F.col("n").isNull(), "heading without node"), F.when(F.col("m").isNull(), "no such heading"), F.when(F.col("n") > 1, "heading of several nodes"), F.when(F.col("m") > 1, "heading repeated"))
    out = out.union(both.select("id", F.explode(F.array_compact(rule)).alias("rule")))
    return out.union(nodes.groupBy(F.col("node_id").alias("id")).count().where("count > 1").select("id", F.lit("node repeated")))


def metadata_violations(metadata: DataFrame, cases: DataFrame, allowed: Mapping[str, list[str]]) -> DataFrame:
    """case_id and rule: metadata must cover every case once, with codes that are allowed, some and each once.

    ``allowed`` are the codes of each array column.
    """
    rules = []
    for name, codes in allowed.items():
        bad = F.size(F.array_except(name, F.array(*map(F.lit, codes)))) > 0
        rules += [
            F.when(F.col(name).isNull() | (F.size(name) == 0), f"{name} empty"), F.when(bad, f"{name} unknown"), F.when(F.size(F.array_distinct(name)) < F.size(name), f"{name} repeated"),
        ]
    out = metadata.select("case_id", F.explode(F.array_compact(F.array(*rules))).alias("rule"))
    out = out.union(metadata.select("case_id").join(cases.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("no such case")))
    out = out.union(cases.select("case_id").join(metadata.select("case_id"), "case_id", "left_anti").select("case_id", F.lit("missing")))
    return out.union(metadata.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("repeated")))


def _finite(x: Any) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def baseline_problems(baseline: Mapping[str, Any], identity: Mapping[str, Any], names: tuple[str, ...] = FEATURES) -> list[str]:
    """What is wrong with a published model: its identity, feature names and numbers."""
    out = [f"{k} is not {v!r}" for k, v in identity.items() if baseline.get(k) != v]
    if tuple(baseline.get("feature_names") or ()) != names:
        out.append("feature_names")
    t = baseline.get("training")
    if not isinstance(t, Mapping):
        return [*out, "no training"]
    for k in ("feature_means", "feature_scales", "coefficients"):
        if not isinstance(t.get(k), list) or len(t[k]) != len(names) or not all(map(_finite, t[k])):
            out.append(f"training.{k}")
        elif k == "feature_scales" and min(t[k]) <= 0:
            out.append("a scale is not above 0")
    out += [f"training.{k}" for k in ("intercept", "selected_threshold") if not _finite(t.get(k))]
    if _finite(t.get("selected_threshold")) and not 0 <= t["selected_threshold"] <= 1:
        out.append("the threshold is outside 0..1")
    return out


def model_of(baseline: Mapping[str, Any], identity: Mapping[str, Any] | None = None) -> Model:
    """The model that a published baseline describes, if it keeps its contract."""
    require(baseline_problems(baseline, identity or {}), "baseline")
    t = baseline["training"]
    return Model(tuple(t["coefficients"]), t["intercept"], tuple(t["feature_means"]), tuple(t["feature_scales"]), t["selected_threshold"])


def file_problems(path: str | Path, size: int, sha256: str) -> list[str]:
    """What differs between a file and its pinned size and hash; the hash is read only if the size fits."""
    file = Path(path)
    if not file.is_file():
        return [f"no file {file}"]
    if file.stat().st_size != size:
        return [f"{file.stat().st_size} bytes, not {size}"]
    with file.open("rb") as f:
        found = hashlib.file_digest(f, "sha256").hexdigest()
    return [] if found == sha256 else [f"sha256 {found}, not {sha256}"]


def version_problems(installed: Mapping[str, str], pinned: Mapping[str, str]) -> list[str]:
    """Libraries whose installed version isn't the pinned one."""
    return [f"{k} {installed.get(k)}, not {v}" for k, v in pinned.items() if installed.get(k) != v]


@dataclass(frozen=True)
class Interface:
    """What a model's session must look like: (name, type, rank) of its ends and the last dimension of each output."""

    providers: tuple[str, ...]
    inputs: tuple[tuple[str, str, int], ...]
    outputs: tuple[tuple[str, str, int], ...]
    widths: tuple[int | None, ...] = ()


def session_problems(session: Any, wanted: Interface) -> list[str]:
    """What differs between an inference session and its interface."""
    try:
        providers, ends = tuple(session.get_providers()), (tuple(session.get_inputs()), tuple(session.get_outputs()))
        shapes = [tuple((e.name, e.type, len(e.shape)) for e in side) for side in ends]
        widths = [e.shape[-1] if len(e.shape) else None for e in ends[1]]
    except (AttributeError, TypeError):
        return ["not an inference session"]
    out = [] if providers == wanted.providers else [f"providers {providers}"]
    out += [f"{side} {have}" for side, have, want in zip(("inputs", "outputs"), shapes, (wanted.inputs, wanted.outputs), strict=True) if have != want]
    out += [f"output {i} has width {have}, not {want}" for i, (have, want) in enumerate(zip(widths, wanted.widths, strict=False)) if want is not None and have != want]
    return out


def vocabulary_problems(content: bytes, sha256: str, special: Mapping[str, int], size: int) -> list[str]:
    """What differs between a vocabulary of one piece a line and its pinned hash, size and places of special pieces."""
    out = [] if hashlib.sha256(content).hexdigest() == sha256 else ["sha256"]
    try:
        pieces = content.decode("utf-8").split("\n")
    except UnicodeDecodeError:
        return [*out, "not UTF-8"]
    pieces = [p.rstrip("\r") for p in (pieces[:-1] if pieces[-1] == "" else pieces)]
    if len(pieces) != size:
        out.append(f"{len(pieces)} pieces, not {size}")
    if len(set(pieces)) != len(pieces):
        out.append("a piece is repeated")
    return out + [f"{p} is not piece {i}" for p, i in special.items() if not 0 <= i < len(pieces) or pieces[i] != p]
