"""What a front end shows of a result: JSON, or Markdown as an adjacency list."""

from __future__ import annotations

import json
from bisect import bisect_right

from spanforge.schema import CONTENT

#: bytes of a response beyond which it is refused
MAX_BYTES = 1 << 20
NAMES, SIGNATURE, BODY = "names", "signature", "body"
_DOCUMENTATION = 10


class TooLarge(Exception):
    """A response of more than MAX_BYTES."""


class Lines:
    """Lines of a file by byte offset; only LF ends a line."""

    def __init__(self, content: bytes):
        self.content = content
        self.starts = [0] + [i + 1 for i, b in enumerate(content) if b == 10]

    def of(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def text(self, start: int, end: int) -> str:
        return self.content[start:end].decode("utf-8", "replace")


def to_json(graph: dict) -> str:
    return checked(json.dumps(graph, ensure_ascii=False))


def checked(text: str) -> str:
    if len(text.encode()) > MAX_BYTES:
        raise TooLarge(f"the response has more than {MAX_BYTES} bytes: ask for fewer symbols")
    return text


def to_markdown(query: str, graph: dict, sources: dict[str, bytes], projection: str = NAMES) -> str:
    """``graph`` of ``index.to_graph``; ``sources``: contents by object id, for line numbers and text."""
    if projection not in (NAMES, SIGNATURE, BODY):
        raise ValueError(f"there is no projection {projection!r}")
    paths = {o["object_id"]: o["path"] for o in graph["objects"]}
    lines = {i: Lines(raw) for i, raw in sources.items()}
    by_id = {n["id"]: n for n in graph["nodes"]}

    def first(node: dict) -> dict:
        """The occurrence that stands for a symbol: a definition, in order of files."""
        return min(node["symbol_instances"], key=lambda i: (i["instance_type"] != 1, paths[i["object_id"]], i["start_offset"]))

    def place(node: dict) -> str:
        i = first(node)
        at = lines.get(i["object_id"])
        return f"{paths[i['object_id']]}:{at.of(i['start_offset'])}" if at else paths[i["object_id"]]

    def order(node: dict) -> tuple:
        i = first(node)
        return paths[i["object_id"]], i["start_offset"], node["id"]

    def source(node: dict) -> list[str]:
        """Its documentation and definition, or the first line of that."""
        if projection == NAMES:
            return []
        found = sorted((i for i in node["symbol_instances"] if i["instance_type"] in (1, _DOCUMENTATION)), key=lambda i: (i["instance_type"] == 1, i["start_offset"]))
        out = []
        for i in found:
            at = lines.get(i["object_id"])
            if at and not (projection == SIGNATURE and i["instance_type"] == _DOCUMENTATION):
                whole = at.text(i["start_offset"], i["end_offset"])
                out.append(whole.split("\n", 1)[0] if projection == SIGNATURE else whole)
        return ["```", *out, "```"] if out else []

    below: dict[str, dict[str, str]] = {}
    for kind, a, b, edges in (("→", "from", "to", graph["edges"]), ("▸", "parent", "child", graph["has_edges"])):
        for e in edges:
            below.setdefault(e[a], {}).setdefault(e[b], kind)
    targets = {t for x in below.values() for t in x}
    out = ["# Query", "```", query.strip(), "```", "", "# Stats", f"{len(by_id)} symbols, {len(graph['edges'])} references, {len(graph['has_edges'])} containments", ""]
    notes = [f"- the first {len(by_id)} of {graph['total_symbols']} symbols"] * graph["truncated"]
    for w in graph["warnings"]:
        more = f"; did you mean {', '.join(w['suggestions'])}?" if w["suggestions"] else "; the name exists, other filters exclude it" if w["name_exists"] else ""
        notes.append(f"- {w['message']}{more}")
    if notes:
        out += ["# Warnings", *notes, ""]
    out.append("# Results")
    if not by_id:
        out.append("_nothing_")
    for node in sorted((n for n in by_id.values() if n["id"] in below or n["id"] not in targets), key=order):
        if any(i["symbol_type"] == CONTENT for i in node["symbol_instances"]):
            for i in sorted(node["symbol_instances"], key=lambda i: (paths[i["object_id"]], i["start_offset"])):
                at = lines.get(i["object_id"])
                where = f"{paths[i['object_id']]}:{at.of(i['start_offset'])}" if at else paths[i["object_id"]]
                out.append(f"- `{node['label']}` {where}")
            continue
        out += [f"- `{node['label']}` {place(node)}", *source(node)]
        kids = [(kind, by_id[t]) for t, kind in below.get(node["id"], {}).items() if t in by_id]
        out += [f"  {kind} `{n['label']}` {place(n)}" for kind, n in sorted(kids, key=lambda k: (k[0] != "→", order(k[1])))]
    return checked("".join(f"{line}\n" for line in out))
