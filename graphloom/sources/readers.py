"""Sources: settings, ontology, PDF files, parser output."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, fields
from pathlib import Path, PurePosixPath
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import EQUATION_TYPES

BLOCKS = "document_id string, block_no int, page_number int, block_type string, text string, bbox array<double>"


@dataclass(frozen=True)
class Settings:
    """Typed settings with defaults; from_env reads GRAPHLOOM_ names."""

    parser: str = "auto"
    parser_key: str = ""
    embedding_key: str = ""
    auto_merge_threshold: float = 0.99
    candidate_threshold: float = 0.85
    temperature: float = 0.3
    embedding_dimensions: int = 1024
    poll_interval: float = 5.0
    poll_timeout: float = 900.0

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        found = {f.name: type(f.default)(env[f"GRAPHLOOM_{f.name.upper()}"]) for f in fields(cls) if f"GRAPHLOOM_{f.name.upper()}" in env}
        out = cls(**found)
        if out.embedding_dimensions not in (256, 512, 1024, 2048):
            raise ValueError("embedding dimensions are 256, 512, 1024 or 2048")
        return out


def parser_for(settings: Settings) -> str:
    """remote or local: auto is remote where a key is set."""
    if settings.parser == "auto":
        return "remote" if settings.parser_key else "local"
    if settings.parser not in ("remote", "local"):
        raise ValueError(f"unknown parser {settings.parser}")
    if settings.parser == "remote" and not settings.parser_key:
        raise ValueError("the remote parser needs a key")
    return settings.parser


def embedder_for(settings: Settings) -> str:
    """remote where a key is set, else the local hash."""
    return "remote" if settings.embedding_key else "local-hash"


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, filename, content) of the PDF files of a folder, whatever the case of their ending."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(F.lower("path").endswith(".pdf")).select("path", F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def new_documents(files: DataFrame) -> DataFrame:
    """Document rows of fresh files, ids from their path; they await parsing."""
    return files.select(
        F.sha2("path", 256).alias("id"), "filename", F.col("path").alias("storage_path"), F.lit("parsing").alias("status"),
        F.lit(0).alias("page_count"), F.lit(0).alias("sentence_count"), F.current_timestamp().alias("created_at"),
    )


def ontology(spark: SparkSession, path: str) -> tuple[str, DataFrame, DataFrame]:
    """Version, entity types and relation types of an ontology file of two-space indented keys.

    Reads the subset such files use: nested keys, scalars, and lists as [a, b] or dashes.
    """
    tree: dict[str, Any] = {}
    stack: list[tuple[int, Any]] = [(-1, tree)]
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        depth, body = len(line) - len(line.lstrip()), line.strip()
        if body.startswith("- "):
            holder = next(x for d, x in reversed(stack) if d < depth or (d == depth and isinstance(x, list)))
            holder.append(body[2:].strip().strip("\"'"))
            continue
        while stack[-1][0] >= depth:
            stack.pop()
        key, _, value = body.partition(":")
        value = value.strip()
        if value.startswith("["):
            held: Any = [x.strip().strip("\"'") for x in value.strip("[]").split(",") if x.strip()]
        elif value:
            held = value.strip("\"'")
        else:
            held = [] if key in ("subject_types", "object_types") else {}
        stack[-1][1][key.strip("\"'")] = held
        if not value:
            stack.append((depth, held))
    e = [(k, v.get("label"), v.get("description")) for k, v in tree.get("entity_types", {}).items()]
    r = [(k, v.get("label"), list(v.get("subject_types") or []), list(v.get("object_types") or [])) for k, v in tree.get("relation_types", {}).items()]
    return (
        str(tree.get("version", "")),
        spark.createDataFrame(e, "entity_type string, label string, description string"),
        spark.createDataFrame(r, "relation_type string, label string, subject_types array<string>, object_types array<string>"),
    )


def content_list(folder: str) -> str:
    """The parser's block list in a folder, the newer form first; it must be a JSON list."""
    for pattern in ("*content_list_v2.json", "*content_list.json"):
        found = sorted(Path(folder).rglob(pattern))
        if found:
            if not isinstance(json.loads(found[0].read_text(encoding="utf-8")), list):
                raise ValueError(f"{found[0].name} holds no list")
            return str(found[0])
    raise FileNotFoundError("no block list")


def unpack(archive: str, target: str) -> None:
    """Extracts an archive, refusing members that would leave the target."""
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            part = PurePosixPath(name.replace("\\", "/"))
            if part.is_absolute() or ".." in part.parts or ":" in part.parts[0]:
                raise ValueError(f"unsafe path {name}")
        z.extractall(target)


def _nodes_with_text(node: Any) -> set[int]:
    """Identities of the nodes that hold any text, found without recursion."""
    order, todo = [], [(node, 0)]
    while todo:
        x, parent = todo.pop()
        if isinstance(x, (dict, list)):
            order.append((x, parent))
            inside = x if isinstance(x, list) else [v for k, v in x.items() if k not in ("bbox", "type")]
            todo += [(y, id(x)) for y in inside if isinstance(y, (dict, list))]
    found: set[int] = set()
    for x, parent in reversed(order):
        if id(x) in found or (isinstance(x, dict) and isinstance(x.get("content"), str) and x["content"]):
            found |= {id(x), parent}
    return found


def rendered(node: Any) -> str:
    """The text of a parse node, iteratively so that depth is no limit: inline formulas in $, display ones in $$."""
    telling = _nodes_with_text(node)
    out: list[str] = []
    todo: list[Any] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += [y for y in reversed(x) if isinstance(y, (list, dict))]
        elif isinstance(x, dict):
            kind, held = str(x.get("type", "")), x.get("content")
            if isinstance(held, str):
                out.append(f" ${held.strip()}$ " if kind == "equation_inline" else f"$${held.strip()}$$" if kind in EQUATION_TYPES else held)
            elif id(held) in telling:
                todo.append(held)
            else:
                todo += [v for k, v in reversed(list(x.items())) if k not in ("bbox", "type") and isinstance(v, (list, dict))]
    return "".join(out)


def _box(value: Any) -> list[float] | None:
    try:
        return [float(v) for v in value] if isinstance(value, list) and len(value) == 4 else None
    except (TypeError, ValueError):
        return None


def _block_text(block: dict) -> str:
    import re

    text = rendered(block.get("content", {}) if isinstance(block.get("content", {}), (dict, list)) else {"content": block["content"]}).strip()
    if block.get("type") in EQUATION_TYPES:
        return text if text.startswith("$$") or not text else f"$${text}$$"
    return re.sub(r"\s+([,.;:!?。！？；])", r"\1", re.sub(r"[ \t]+", " ", text))


def parsed_blocks(files: DataFrame) -> DataFrame:
    """Blocks of parser output (document_id, json): pages of nested blocks, or the older flat list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, raw in zip(batch["document_id"], batch["json"]):
                try:
                    pages = json.loads(raw) if raw else []
                except ValueError:
                    continue
                no = 0
                for at, page in enumerate(pages if isinstance(pages, list) else []):
                    flat = isinstance(page, dict)
                    for block in [page] if flat else page if isinstance(page, list) else []:
                        if isinstance(block, dict):
                            text = str(block.get("text") or "") if flat else _block_text(block)
                            number = int(block.get("page_idx") or 0) + 1 if flat else at + 1
                            rows.append((doc, no, number, str(block.get("type", "")), text, _box(block.get("bbox"))))
                            no += 1
            yield pd.DataFrame(rows, columns=["document_id", "block_no", "page_number", "block_type", "text", "bbox"])

    return files.select("document_id", "json").mapInPandas(run, BLOCKS)
