"""Content packs: mappings, exclusions and combiner specifications as one JSON text with a checksum."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from tidewright.operators.combine import Filter, Join, Spec
from tidewright.operators.exclude import Exclusion
from tidewright.operators.transform import FieldRule, Mapping, Target

VERSION = 1


def _sum(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


def export_pack(mappings: dict[str, Mapping], exclusions: list[Exclusion] = (), specs: dict[str, Spec] | None = None) -> str:
    body = {"version": VERSION, "mappings": {k: asdict(v) for k, v in mappings.items()}, "exclusions": [asdict(x) for x in exclusions], "specs": {k: asdict(v) for k, v in (specs or {}).items()}}
    body = json.loads(json.dumps(body))
    return json.dumps({"body": body, "sha256": _sum(body)}, indent=1, sort_keys=True, ensure_ascii=False)


def import_pack(text: str) -> tuple[dict[str, Mapping], list[Exclusion], dict[str, Spec]]:
    """What was exported; a text that was changed, or of another version, is refused. Imported mappings are drafts."""
    pack = json.loads(text)
    body = pack.get("body")
    if body is None or pack.get("sha256") != _sum(body):
        raise ValueError("the pack was changed")
    if body["version"] != VERSION:
        raise ValueError(f"version {body['version']} is not read")
    mappings = {}
    for name, m in body["mappings"].items():
        rules = tuple(FieldRule(**{**r, "target": Target(**{**r["target"], "check_values": tuple(r["target"]["check_values"])})}) for r in m["rules"])
        conditional = {k: (v[0], tuple(v[1]) if isinstance(v[1], list) else v[1], v[2]) for k, v in m["conditional"].items()}
        mappings[name] = Mapping(rules, tuple(m["source_pk"]), tuple(m["passthrough"]), m["fallback"], m["default"], "DRAFT", conditional)
    exclusions = [Exclusion(**{**x, "values": tuple(x["values"])}) for x in body["exclusions"]]
    specs = {}
    for name, s in body["specs"].items():
        joins = tuple(Join(**{**j, "on": tuple(tuple(p) for p in j["on"])}) for j in s["joins"])
        filters = tuple(Filter(**{**f, "values": tuple(f["values"])}) for f in s["filters"])
        specs[name] = Spec(s["base"], s["alias"], joins, filters, tuple(s["columns"]))
    return mappings, exclusions, specs
