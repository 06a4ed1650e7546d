"""Tools over the engine for language-model clients: a registry with schemas, a bounded chat loop, and a JSON server.

A tool's result is a small table as a list of dicts. The batch that a session is scoped to never comes from the model:
it is no parameter of a tool's schema, and is put into every call that takes one.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame

from ..operators import evaluation
from .engine import MatchEngine, get_engine

#: Rounds of tool calls in one answer, and rows of a result.
ROUNDS, ROWS = 4, 200


def rows(df: DataFrame, most: int = ROWS, offset: int | None = None) -> list[dict]:
    """The rows of a result, refused if they are more than `most`; with an offset, `most` of them from there on."""
    if offset is not None:
        return [json.loads(x) for x in df.offset(int(offset)).limit(most).toJSON().collect()]
    got = df.limit(most + 1).toJSON().collect()
    if len(got) > most:
        raise ValueError(f"{df.count()} rows; ask for {most} at a time, with an offset from 0")
    return [json.loads(x) for x in got]


_SKILLS = {"type": "object", "additionalProperties": {"type": "number"}}
#: name -> (what it does, schema of its parameters, whether it is scoped to a batch, call).
TOOLS: dict[str, tuple[str, dict, bool, Callable]] = {
    "rank_candidates": ("Rank the pool for wanted skills with weights.", {"jd_skills": _SKILLS, "top_k": {"type": "integer"}, "offset": {"type": "integer"}}, True, lambda e, jd_skills, top_k=None, offset=None, batch=None: rows(e.rank_candidates(jd_skills, batch=batch, top_k=top_k), offset=offset)),
    "get_bridgeable_gaps": ("What a profile lacks of the wanted skills, and what bridges it.", {"jd_skills": _SKILLS, "candidate_skills": _SKILLS}, False, lambda e, jd_skills, candidate_skills: rows(e.gap_response(jd_skills, candidate_skills))),
    "explain_score": ("A score in its terms.", {"jd_skills": _SKILLS, "candidate_skills": _SKILLS}, False, lambda e, jd_skills, candidate_skills: rows(e.explain_response(jd_skills, candidate_skills))),
    "list_candidates": ("The candidates of the pool.", {"offset": {"type": "integer"}}, True, lambda e, offset=None, batch=None: rows(e.list_candidates(batch).orderBy("name", "candidate_id"), offset=offset)),
    "graph_stats": ("The size of the skill graph.", {}, False, lambda e: rows(e.graph_stats())),
}


def schemas() -> list[dict]:
    """name, description and parameters of every tool, as models are told them; without the batch."""
    return [{"name": n, "description": d, "parameters": {"type": "object", "properties": p}} for n, (d, p, *_) in TOOLS.items()]


def call(name: str, arguments: dict, batch: str | None = None, engine: MatchEngine | None = None) -> dict:
    """The result of a tool, or its error; arguments that the schema doesn't have are refused."""
    if name not in TOOLS:
        return {"error": f"no tool {name}"}
    _, params, scoped, run = TOOLS[name]
    if odd := sorted(set(arguments) - set(params)):
        return {"error": f"unknown arguments: {', '.join(odd)}"}
    try:
        return {"result": run(engine or get_engine(), **arguments, **({"batch": batch} if scoped else {}))}
    except (ValueError, TypeError, RuntimeError) as e:
        return {"error": f"{type(e).__name__}: {e}"}


@dataclass
class ChatResponse:
    text: str
    calls: list[dict] = field(default_factory=list)


def chat(client: Callable[[list[dict], list[dict]], dict], message: str, batch: str | None = None, engine: MatchEngine | None = None, rounds: int = ROUNDS) -> ChatResponse:
    """An answer of a client: a function of messages and schemas that gives {"text": ...} or {"calls": [{"name", "arguments"}]}.

    Results go back to it for at most so many rounds; every call is recorded. A client that still calls then is asked
    for its text without tools.
    """
    messages, made = [{"role": "user", "content": message}], []
    for _ in range(rounds):
        said = client(messages, schemas())
        if not said.get("calls"):
            return ChatResponse(said.get("text", ""), made)
        for c in said["calls"]:
            got = call(c["name"], c.get("arguments", {}), batch, engine)
            made.append({"name": c["name"], "arguments": c.get("arguments", {}), **got})
            messages.append({"role": "tool", "name": c["name"], "content": json.dumps(got)})
    return ChatResponse(client(messages, []).get("text", ""), made)


def extraction_node(state: dict, engine: MatchEngine | None = None) -> dict:
    """A step of a state graph: the skills of state["text"] as state["skills"], errors as state["error"]."""
    try:
        found = rows((engine or get_engine()).extract_jd_skills(state.get("text") or ""))
        return state | {"skills": {r["skill"]: r["weight"] for r in found}, "error": None}
    except (ValueError, RuntimeError) as e:
        return state | {"skills": {}, "error": f"{type(e).__name__}: {e}"}


def answer(engine: MatchEngine, method: str, path: str, body: dict, client=None, jds: list[dict] | None = None) -> tuple[int, dict]:
    """Status and JSON of a request: /health, /api/jds, /api/candidates, /api/jd_skills, /api/rank, /api/rank_pool, /api/chat."""
    url = urlsplit(path)
    query = {k: v[0] for k, v in parse_qs(url.query).items()}
    try:
        match (method, url.path):
            case ("GET", "/health"):
                up = engine.store.ping()
                return (200 if up else 503), {"status": "ok" if up else "unavailable"}
            case ("GET", "/api/jds"):
                return 200, {"jds": rows(engine.list_eval_jds(jds if jds is not None else evaluation.Generator().jds(), query.get("split")))}
            case ("GET", "/api/candidates"):
                found = engine.list_candidates(query.get("batch_id")).orderBy("name", "candidate_id")
                return 200, {"candidates": rows(found, offset=query.get("offset")), "total": found.count()}
            case ("POST", "/api/candidates"):
                return 200, rows(engine.upload(body["name"], base64.b64decode(body["content"]), body.get("batch_id")))[0]
            case ("POST", "/api/jd_skills"):
                return 200, {"skills": {r["skill"]: r["weight"] for r in rows(engine.extract_jd_skills(body["text"]))}}
            case ("POST", "/api/rank"):
                return 200, rows(engine.ranking_response(body["jd_skills"], body["candidates"], top_k=body.get("top_k")))[0]
            case ("POST", "/api/rank_pool"):
                return 200, rows(engine.ranking_response(body["jd_skills"], None, body.get("batch_id"), body.get("top_k")))[0]
            case ("POST", "/api/chat"):
                if client is None:
                    return 503, {"error": "no language model"}
                got = chat(client, body["message"], body.get("batch_id"), engine)
                return 200, {"text": got.text, "calls": got.calls}
        return 404, {"error": f"{method} {url.path}"}
    except (KeyError, ValueError, TypeError) as e:
        return 400, {"error": f"{type(e).__name__}: {e}"}


def server(engine: MatchEngine, port: int = 8000, host: str = "127.0.0.1", client=None) -> ThreadingHTTPServer:
    """A JSON server of answer(); serve_forever() runs it."""

    class Handler(BaseHTTPRequestHandler):
        def respond(self) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                status, out = answer(engine, self.command, self.path, json.loads(raw) if raw else {}, client)
            except json.JSONDecodeError as e:
                status, out = 400, {"error": str(e)}
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = respond

        def log_message(self, *args) -> None:
            """Requests aren't logged: they may hold profiles."""

    return ThreadingHTTPServer((host, port), Handler)
