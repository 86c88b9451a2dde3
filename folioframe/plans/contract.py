"""Contracts of templates: which payload value goes where, checked, scaffolded and compiled into mapping entries.

A contract and its payload are one file each, parsed on the driver; what is filled and searched with
the compiled entries is distributed (``plans.fill``).
"""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions import text as T
from folioframe.operators import document as D

#: Modes by binding, schema of a mapping file, bounds.
FIELD_MODES = ("replace", "table-right", "table-down", "table-left", "table-up", "paragraph-next")
TABLE_MODES = ("table-down-repeat", "table-right-grid", "table-down-records")
MAPPING_SCHEMA = re.compile(r"([\w.-]+/)?fill-template-mapping/v1")
MOST_LABELS, PREVIEW_BYTES, PREVIEW_VALUES = 12, 120, 3
SELECTORS = {"placeholder": "placeholder", "near-text": "nearText", "anchor": "anchor"}


def parsed(raw: str | bytes, what: str):
    """JSON, else YAML where a reader for it is installed."""
    try:
        return json.loads(raw)
    except ValueError:
        pass
    try:
        import yaml
    except ImportError:
        raise ValueError(f"{what}: not JSON, and no reader for YAML is installed") from None
    try:
        return yaml.safe_load(raw)
    except yaml.YAMLError as e:
        raise ValueError(f"{what}: neither JSON nor YAML: {e}") from e


def _read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _camel(value):
    """Keys as in JSON: template_id -> templateId."""
    if isinstance(value, dict):
        return {(k.split("_")[0] + "".join(p.title() for p in k.split("_")[1:]) if isinstance(k, str) else k): _camel(v) for k, v in value.items()}
    return [_camel(v) for v in value] if isinstance(value, list) else value


def load_contract(path: str) -> dict:
    found = parsed(_read(path), "contract")
    if not isinstance(found, dict):
        raise ValueError("contract: an object is expected")
    contract = _camel(found)
    if issues := contract_issues(contract):
        raise ValueError("invalid contract: " + "; ".join(f"{path} {code}" for path, code in issues))
    return contract


def load_payload(path: str) -> dict:
    found = parsed(_read(path), "payload")
    if not isinstance(found, dict) or not found:
        raise ValueError("payload: a non-empty object is expected")
    return found


def mapping_entries(found) -> list[dict]:
    """The entries of a mapping: a list, or an object that holds ``entries`` or ``replacements``, not both."""
    if isinstance(found, list):
        return found
    if not isinstance(found, dict):
        raise ValueError("mapping: a list or an object is expected")
    if found.get("schemaVersion") and not MAPPING_SCHEMA.fullmatch(found["schemaVersion"]):
        raise ValueError(f"mapping: unknown schema version {found['schemaVersion']}")
    held = [k for k in ("entries", "replacements") if found.get(k)]
    if len(held) != 1:
        raise ValueError("mapping: exactly one of entries and replacements is needed")
    return found[held[0]]


def load_mapping(path: str) -> list[dict]:
    return mapping_entries(parsed(_read(path), "mapping"))


def mode_of(value: str | None) -> str:
    return (value or "").strip().lower().replace("_", "-")


def _places(contract: dict) -> dict[str, tuple[object, str]]:
    """Every place of a contract that a rule speaks of: path -> (its value, the rule)."""
    size = (contract.get("fingerprint") or {}).get("sectionCount")
    out: dict[str, tuple[object, str]] = {"templateId": (contract.get("templateId"), "text"), "templateVersion": (contract.get("templateVersion"), "text"), "fingerprint.sectionCount": (size, "positive")}
    for kind in ("fields", "tables"):
        for i, binding in enumerate(contract.get(kind) or []):
            at, selector = f"{kind}[{i}]", binding.get("selector") or {}
            out |= {
                f"{at}.key": (binding.get("key"), f"own {kind}"), f"{at}.mode": (binding.get("mode"), f"mode {kind}"), f"{at}.selector.type": (selector.get("type"), f"selector {kind}"),
                f"{at}.selector.value": (selector.get("value"), "text"), f"{at}.selector.matchMode": (selector.get("matchMode"), "match"),
            }
            out |= {f"{at}.columns[{j}].{k}": (c.get(k), "text") for j, c in enumerate(binding.get("columns") or []) for k in ("key", "source")}
    return out


#: What a value may be where only some are known; "" stands for none.
KNOWN = {
    "mode fields": ("", *FIELD_MODES), "mode tables": ("", *TABLE_MODES), "selector fields": tuple(SELECTORS), "selector tables": ("anchor",), "match": ("", "exact", "contains"),
}


def contract_issues(contract: dict) -> list[tuple[str, str]]:
    """(path, code) of everything that is wrong with a contract: ``missing``, ``unknown``, ``repeated``."""
    found, keys = [] if contract.get("fields") or contract.get("tables") else [("fields", "missing")], set()
    for path, (value, rule) in _places(contract).items():
        said = str(value or "").strip()
        if rule in KNOWN:
            code = "" if mode_of(said) in KNOWN[rule] else "unknown"
        elif rule == "positive":
            code = "" if (value or 0) > 0 else "missing"
        else:
            code = "missing" if not said else "repeated" if (rule, value) in keys else ""
            if rule.startswith("own"):
                keys.add((rule, value))
        if code:
            found.append((path, code))
    return found


def payload_value(value, path: str):
    """(found, value) at a dotted path; no array indexes."""
    for part in path.strip().split("."):
        if not part.strip() or not isinstance(value, dict) or part.strip() not in value:
            return False, None
        value = value[part.strip()]
    return True, value


def scalar(value) -> str:
    if value is None or isinstance(value, dict | list):
        raise ValueError("value is null" if value is None else "value must be scalar")
    return str(value).lower() if isinstance(value, bool) else str(value)


def is_grid(value) -> bool:
    return isinstance(value, list) and bool(value) and all(isinstance(r, list) for r in value)


def is_list(value) -> bool:
    return isinstance(value, list) and bool(value) and not any(isinstance(x, list) for x in value)


def cut(text: str) -> str:
    raw = text.encode()
    return text if len(raw) <= PREVIEW_BYTES else raw[:PREVIEW_BYTES].decode("utf-8", "replace").strip() + "..."


def resolution(source: str, entry: dict, **more) -> dict:
    """What one entry came to: selector, mode, and the kind, count and a preview of its values."""
    kind = next((k for k in ("records", "grid", "values") if entry.get(k)), "value")
    v = entry.get(kind)
    preview = {
        "records": lambda: ", ".join(f"{f}={v[0].get(f, '')}" for f in entry.get("fields") or v[0]), "grid": lambda: " | ".join(v[0]),
        "values": lambda: ", ".join(v[:PREVIEW_VALUES]), "value": lambda: str(v or "").strip(),
    }[kind]()
    chosen = next(s for s in ("placeholder", "near-text", "anchor") if entry.get(SELECTORS[s]) or s == "anchor")
    return {
        "source": source, "key": (entry.get("key") or "").strip(), "note": (entry.get("note") or "").strip(), "selectorType": chosen, "selector": entry.get(SELECTORS[chosen], ""),
        "mode": mode_of(entry.get("mode")), "valueKind": kind, "valuePreview": cut(preview), "valueCount": 1 if kind == "value" else 0 if kind == "records" else len(v), "recordCount": len(v) if kind == "records" else 0,
        "fields": list(entry.get("fields") or []), "required": bool(entry.get("required")), "unique": bool(entry.get("unique")), "expand": bool(entry.get("expand")), "skipped": False,
    } | more


def compiled(contract: dict, payload: dict) -> tuple[list[dict], list[dict]]:
    """Mapping entries, and one report for every binding in order; a missing required value is an error."""
    if issues := contract_issues(contract):
        raise ValueError("invalid contract: " + "; ".join(f"{path} {code}" for path, code in issues))
    entries, told = [], []
    for kind, bindings in (("field", contract.get("fields") or []), ("table", contract.get("tables") or [])):
        for b in bindings:
            selector = b["selector"]
            chosen = mode_of(selector["type"])
            entry = {SELECTORS[chosen]: selector["value"], "matchMode": mode_of(selector.get("matchMode")), "tableLabel": (selector.get("tableLabel") or "").strip(), "required": bool(b.get("required"))}
            found, value = payload_value(payload, b["key"])
            fallback = not found and kind == "field" and bool((b.get("fallbackValue") or "").strip())
            if fallback:
                found, value = True, b["fallbackValue"]
            if not found:
                if b.get("required"):
                    raise ValueError(f"payload is missing required {kind} {b['key']!r}")
                told.append(resolution(kind, entry, key=b["key"], payloadPath=b["key"], index=len(told), skipped=True, skipReason=f"payload missing optional {kind}", valueKind="", valuePreview="", valueCount=0, recordCount=0))
                continue
            try:
                entry |= field_value(b, value, chosen) if kind == "field" else table_value(b, value)
            except ValueError as e:
                raise ValueError(f"{kind} {b['key']!r}: {e}") from e
            entry["sourceIndex"] = len(told)
            told.append(resolution(kind, entry, key=b["key"], payloadPath=b["key"], index=len(told), usedFallback=fallback))
            entries.append(entry)
    return entries, told


def field_value(binding: dict, value, chosen: str) -> dict:
    usual = {"placeholder": "replace", "near-text": "paragraph-next", "anchor": "table-right"}[chosen]
    return {"mode": mode_of(binding.get("mode")) or usual, "value": scalar(value)}


def table_value(binding: dict, value) -> dict:
    """Records by the columns' paths, a grid, a list or one value, by the payload's shape."""
    columns, expand = binding.get("columns") or [], bool(binding.get("expand"))
    mode = mode_of(binding.get("mode"))
    if columns:
        if not isinstance(value, list):
            raise ValueError("an array payload is expected")
        records = []
        for i, item in enumerate(value):
            record = {}
            for c in columns:
                found, x = payload_value(item, c["source"])
                if not found:
                    raise ValueError(f"record[{i}] is missing source {c['source']!r}")
                record[c["key"]] = scalar(x)
            records.append(record)
        return {"mode": mode or "table-down-records", "fields": [c["key"] for c in columns], "records": records, "expand": True}
    if is_grid(value):
        return {"mode": mode or "table-right-grid", "grid": [[scalar(x) for x in r] for r in value], "expand": expand}
    if is_list(value):
        return {"mode": mode or "table-down-repeat", "values": [scalar(x) for x in value], "expand": expand}
    return {"mode": mode or "table-right", "value": scalar(value), "expand": expand}


def correlated(told: list[dict], changes: DataFrame, misses: DataFrame, asked: list[dict]) -> list[dict]:
    """The reports with how many changes and misses each entry had (one row an entry comes to the driver)."""
    rid_of = {i: e.get("sourceIndex", i) for i, e in enumerate(asked)}
    count = lambda df: {rid_of.get(r["rid"], r["rid"]): r["n"] for r in df.groupBy("rid").agg(F.count("*").alias("n")).collect()}
    made, missed = count(changes), count(misses)
    return [t | {"changeCount": made.get(t.get("index", i), 0), "missCount": missed.get(t.get("index", i), 0)} for i, t in enumerate(told)]


def fingerprints(elements: DataFrame) -> DataFrame:
    """(doc_id, section_count, section_paths, table_labels, placeholder_texts, placeholder_digest) of every document."""
    paragraphs = D.paragraph_texts(elements)
    tables = D.tables(elements, paragraphs, D.cells(elements))
    labels = tables.withColumn("x", T.trim_unicode(F.col("label"))).where("x <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("x")).alias("table_labels"))
    marks = D.placeholders(paragraphs).groupBy("doc_id").agg(F.array_sort(F.collect_set(T.trim_unicode(F.col("text")))).alias("placeholder_texts"))
    docs = elements.groupBy("doc_id").agg(D.section_paths())
    none = F.array().cast("array<string>")
    out = docs.join(labels, "doc_id", "left").join(marks, "doc_id", "left").withColumns({c: F.coalesce(c, none) for c in ("table_labels", "placeholder_texts")})
    return out.withColumns({"section_count": F.size("section_paths"), "placeholder_digest": F.sha2(F.array_join("placeholder_texts", "\n").cast("binary"), 256)})


def fingerprint_issues(prints: DataFrame, expected: dict) -> DataFrame:
    """(doc_id, issues) of documents that a contract's fingerprint does not fit, ``part: what``; what a document has beyond it is no issue."""
    same = {"section_count": expected.get("sectionCount"), "section_paths": expected.get("sectionPaths"), "placeholder_digest": expected.get("placeholderDigest")}
    within = {"table_labels": expected.get("tableLabels"), "placeholder_texts": expected.get("placeholderTexts")}
    wanted = lambda x: F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, list) else F.lit(x)
    told = lambda c: F.to_json(F.struct(F.col(c).alias("is")))
    differs = [F.when(F.col(c) != wanted(x), F.array(F.concat(F.lit(f"{c}: "), told(c)))) for c, x in same.items() if x]
    told_absent = lambda c: lambda v: F.concat(F.lit(f"{c}: lacks "), v)
    lacks = [F.transform(F.array_except(wanted(list(x)), F.col(c)), told_absent(c)) for c, x in within.items() if x]
    every = F.flatten(F.array_compact(F.array(*differs, *lacks, F.array().cast("array<string>"))))
    return prints.select("doc_id", every.alias("issues")).where("size(issues) > 0")


def scaffold_fields(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, nth, key, selector): a field for each distinct placeholder in order, keys made unique by ``_2``, ``_3``."""
    from pyspark.sql import Window as W

    marks = D.placeholders(paragraphs).withColumn("selector", T.trim_unicode(F.col("text")))
    once = marks.groupBy("doc_id", "selector").agg(F.min(F.struct("section_idx", "all_p_idx")).alias("at"))
    once = once.withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("at")))
    once = once.withColumn("base", T.field_key(T.key_source(F.col("selector")), F.col("nth")))
    again = F.row_number().over(W.partitionBy("doc_id", "base").orderBy("nth"))
    return once.select("doc_id", "nth", F.when(again == 1, F.col("base")).otherwise(F.concat_ws("_", "base", again.cast("string"))).alias("key"), "selector")


def kept_labels(prints: DataFrame) -> DataFrame:
    """prints with table_labels that can serve as such (all of them if none can), sorted, the first twelve."""
    clean = F.array_distinct(F.filter(F.transform("table_labels", T.collapse_blanks), lambda x: x != ""))
    kept = F.filter(clean, T.keeps_label)
    return prints.withColumn("table_labels", F.slice(F.array_sort(F.when(F.size(kept) > 0, kept).otherwise(clean)), 1, MOST_LABELS))


def scaffold(elements: DataFrame, doc_id: str, template_id: str = "", version: str = "1.0.0", strict: bool = False) -> dict:
    """The contract of one document: its fingerprint, and a field for each placeholder; none is an error."""
    one = elements.where(F.col("doc_id") == doc_id)
    fields = [{"key": r["key"], "selector": {"type": "placeholder", "value": r["selector"]}} for r in scaffold_fields(D.paragraph_texts(one)).orderBy("nth").collect()]
    if not fields:
        raise ValueError("no placeholder candidates found")
    row = kept_labels(fingerprints(one)).withColumn("name", T.template_id(F.lit(doc_id))).first()
    print_ = {"sectionCount": row["section_count"], "sectionPaths": row["section_paths"], "tableLabels": row["table_labels"], "placeholderTexts": row["placeholder_texts"], "placeholderDigest": row["placeholder_digest"]}
    return {"templateId": template_id.strip() or row["name"], "templateVersion": version.strip() or "1.0.0", "strict": strict, "fingerprint": print_, "fields": fields}


def assign(root: dict, path: str, value) -> None:
    """Put value at a dotted path; another value there, or one on the way, is a conflict."""
    parts = [p.strip() for p in path.strip().split(".")]
    if not all(parts):
        raise ValueError(f"invalid path {path!r}")
    for p in parts[:-1]:
        root = root.setdefault(p, {})
        if not isinstance(root, dict):
            raise ValueError(f"path {path!r} conflicts with a scalar value")
    if root.setdefault(parts[-1], value) != value:
        raise ValueError(f"path {path!r} conflicts with an existing value")


def payload_skeleton(contract: dict) -> dict:
    """A payload of empty values and fallbacks; tables of columns have one record."""
    out: dict = {}
    for f in contract.get("fields") or []:
        assign(out, f["key"], (f.get("fallbackValue") or "") if (f.get("fallbackValue") or "").strip() else "")
    for t in contract.get("tables") or []:
        record: dict = {}
        for c in t.get("columns") or []:
            assign(record, c["source"], "")
        assign(out, t["key"], [record] if record else [[""]] if mode_of(t.get("mode")) == "table-right-grid" else [""])
    return out


def artifact_format(asked: str, path: str) -> str:
    """json or yaml: as asked, else by the file's ending, else yaml."""
    if asked and asked.lower() not in ("json", "yaml"):
        raise ValueError(f"unknown format {asked}")
    return asked.lower() if asked else "json" if os.path.splitext(path)[1].lower() == ".json" else "yaml"


def written(value: dict, kind: str) -> str:
    if kind == "json":
        return json.dumps(value, ensure_ascii=False, indent=2) + "\n"
    try:
        import yaml
    except ImportError:  # every JSON document is a YAML document
        return json.dumps(value, ensure_ascii=False, indent=2) + "\n"
    return yaml.safe_dump(value, allow_unicode=True, sort_keys=False)
