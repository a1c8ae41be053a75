"""Commands over an engine: names, flags, and errors folded into a result."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from memlake.engine import Engine
from memlake.operators.search import SearchQuery
from memlake.sources.connect import render

READ_ONLY = {"search", "search-table", "run-template", "build-context", "domains", "domain", "tags", "edges", "traverse", "core-list", "skills", "skill", "schedule-list"}


@dataclass
class Call:
    """Positional arguments and flags: ``--name value``, ``--name=value``, a bare ``--name`` is true; a
    repeated flag is a list."""

    words: list[str] = field(default_factory=list)
    flags: dict[str, Any] = field(default_factory=dict)

    def list(self, name: str) -> list[str]:
        value = self.flags.get(name, [])
        values = value if isinstance(value, list) else [value]
        return [part for v in values for part in str(v).split(",") if part]


def parse(argv: Sequence[str]) -> Call:
    call, i = Call(), 0
    while i < len(argv):
        word = argv[i]
        if word.startswith("--") and len(word) > 2:
            name, eq, value = word[2:].partition("=")
            if not eq:
                if i + 1 < len(argv) and not argv[i + 1].startswith("--"):
                    i += 1
                    value = argv[i]
                else:
                    value = True
            old = call.flags.get(name)
            call.flags[name] = value if old is None else [*(old if isinstance(old, list) else [old]), value]
        else:
            call.words.append(word)
        i += 1
    return call


def _query(engine: Engine, call: Call) -> SearchQuery:
    words = " ".join(call.words) or None
    return SearchQuery(
        mode=call.flags.get("mode", "hybrid"), text=words, vector=engine.embed(words) if engine.embed and words else None,
        tags=[f"tag:{t}" for t in call.list("tags")], domains=[f"domain:{d}" for d in call.list("domains")],
        limit=int(call.flags.get("limit", 10)), min_score=float(call.flags.get("min-score", 0)),
        token_budget=int(call.flags["budget"]) if "budget" in call.flags else None,
        before=int(call.flags["before"]) if "before" in call.flags else None, after=int(call.flags["after"]) if "after" in call.flags else None,
    )


COMMANDS: Mapping[str, Callable[[Engine, Call], Any]] = {
    "ingest": lambda e, c: e.ingest(c.words, domains=c.list("domains"), tags=c.list("tags")),
    "write": lambda e, c: e.write(c.words, domains=c.list("domains"), tags=c.list("tags")),
    "search": lambda e, c: e.search(_query(e, c), c.flags.get("as")),
    "build-context": lambda e, c: e.build_context(_query(e, c), int(c.flags.get("budget", 4000))),
    "search-table": lambda e, c: e.search_table(c.words[0], c.words[1], c.flags),
    "run-template": lambda e, c: e.run_template(c.words[0], c.words[1], c.flags),
    "domains": lambda e, c: sorted(e.domains),
    "domain": lambda e, c: vars(e.domains[c.words[0]]),
    "init": lambda e, c: e.bootstrap(c.words[0]),
    "submit": lambda e, c: e.submit(c.words, domains=c.list("domains"), now_ms=int(c.flags.get("now", 0))),
    "process-inbox": lambda e, c: sorted(e.process_inbox(int(c.flags.get("now", 0)))),
    "skills": lambda e, c: [s.id for s in e.skills(c.words[0])],
    "skill": lambda e, c: next(s.content for s in e.skills(c.words[0]) if s.id == c.words[1]),
    "schedule-list": lambda e, c: e.schedules(),
    "update": lambda e, c: e.update(c.words[0], " ".join(c.words[1:]) or None, {k: v for k, v in c.flags.items()}),
    "tags": lambda e, c: e.tags(c.words[0]),
    "tag": lambda e, c: e.tag(c.words[0], *c.words[1:]),
    "untag": lambda e, c: e.untag(c.words[0], c.words[1]),
    "release": lambda e, c: e.release(c.words[0], c.words[1]),
    "delete": lambda e, c: e.store.delete(c.words),
    "edges": lambda e, c: e.edges(c.words[0], c.flags.get("direction", "both")),
    "relate": lambda e, c: e.relate(*c.words[:3]),
    "unrelate": lambda e, c: e.unrelate(*c.words[:3]),
    "traverse": lambda e, c: e.traverse(c.words[0], c.list("edges"), int(c.flags.get("depth", 1))),
    "schedule-run-due": lambda e, c: e.run_due(int(c.flags["now"])),
    "schedule-trigger": lambda e, c: e.trigger(c.words[0], c.words[1]),
    "core-add": lambda e, c: e.pin(c.words[0], c.words[1]),
    "core-remove": lambda e, c: e.unpin(c.words[0], c.words[1]),
    "core-list": lambda e, c: e.core_memories(c.words[0]),
}


def dispatch(engine: Engine, argv: Sequence[str], read_only: bool = False) -> dict[str, Any]:
    """Run one command; ``{"ok": ..., "result" or "error": ...}``, DataFrames as they are unless ``--format`` is given."""
    if not argv or argv[0] not in COMMANDS:
        return {"ok": False, "error": f"no such command: {argv[0] if argv else ''}"}
    if read_only and argv[0] not in READ_ONLY:
        return {"ok": False, "error": f"not allowed: {argv[0]}"}
    call = parse(argv[1:])
    style = call.flags.pop("format", None)
    try:
        result = COMMANDS[argv[0]](engine, call)
        if style and hasattr(result, "columns"):
            result = render(result, style)
        return {"ok": True, "result": result}
    except Exception as problem:  # a command's failure is its result
        return {"ok": False, "error": f"{type(problem).__name__}: {problem}"}
