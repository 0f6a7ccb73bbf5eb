"""Request handling of the research interface, without a server.

``handle`` maps a method, path, headers and body to a status code and a JSON-ready answer, so
any web framework can host it.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from oreweave.operators.research import TextProvider, WebSearch, run_research
from oreweave.plans.pipeline import retriever
from oreweave.sinks.ledger import Ledger, list_runs

MAX_BODY = 256 * 1024
LIMITS = {"/research": (3, 12), "/research/ensemble": (4, 14)}


class ResearchService:
    def __init__(self, ledger: Ledger, writers: list[TextProvider] | None = None, judge: TextProvider | None = None,
                 planner: TextProvider | None = None, api_key: str | None = None, web: WebSearch | None = None) -> None:
        self.ledger, self.writers, self.judge, self.planner, self.api_key = ledger, writers or [], judge, planner, api_key
        self.web = web

    def runs(self) -> list[dict[str, Any]]:
        read = self.ledger.read
        rows = list_runs(read("ingest_runs"), read("document_chunks"), read("kg_embeddings"), read("kg_sync_status"))
        return [r.asDict() for r in rows.collect()]

    def research(self, path: str, request: Mapping[str, Any]) -> dict[str, Any]:
        subqueries, context = LIMITS[path]
        search = retriever(self.ledger, request.get("run_id", "latest"), request.get("mode", "auto"))
        k = int(request.get("top_k", 8))
        result = run_research(
            str(request.get("question") or ""),
            lambda q: search.retrieve(q, k),
            planner=self.planner,
            writers=self.writers if path.endswith("ensemble") else self.writers[:1],
            judge=self.judge,
            max_subqueries=int(request.get("max_subqueries", subqueries)),
            max_context=int(request.get("max_context", context)),
            web=self.web,
            web_max=int(request.get("web_max", 6)),
        )
        return result.to_dict()

    def _allowed(self, headers: Mapping[str, str]) -> bool:
        given = {k.lower(): v for k, v in headers.items()}
        token = given.get("x-api-key") or given.get("authorization", "").removeprefix("Bearer ").strip()
        return not self.api_key or token == self.api_key

    def handle(self, method: str, path: str, headers: Mapping[str, str] | None = None, body: bytes = b"") -> tuple[int, dict[str, Any]]:
        route = path.split("?")[0].rstrip("/") or "/"
        if method == "GET" and route in ("/", "/health"):
            return 200, {"status": "ok", "routes": ["/health", "/runs", *LIMITS]}
        if not self._allowed(headers or {}):
            return 401, {"error": "unauthorized"}
        if method == "GET" and route == "/runs":
            return 200, {"runs": self.runs()}
        if method != "POST" or route not in LIMITS:
            return 404, {"error": "not found"}
        if len(body) > MAX_BODY:
            return 400, {"error": "body too large"}
        try:
            request = json.loads(body or b"{}")
            return 200, self.research(route, request)
        except (ValueError, TypeError) as exc:
            return 400, {"error": str(exc)}
        except Exception as exc:
            return 500, {"error": str(exc)}
