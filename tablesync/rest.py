"""REST surface over a catalog: one group per server, bound on start or by POST /groups.

GET /health /status /metrics /tables; POST /groups /groups/enable /groups/disable /tables
/tables/{name}/resync; DELETE /groups /tables/{name}. Dropping the group drops its targets too.
"""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlsplit

from . import monitor
from .catalog import Catalog, CatalogError, Conflict, NotFound
from .config import ConfigError
from .functions.pgtypes import UnsupportedType


class Unbound(CatalogError):
    pass


class Service:
    """What the routes do, apart from HTTP."""

    def __init__(self, catalog: Catalog, group: str | None = None, source_lsn=lambda: 0):
        self.catalog, self.group, self.source_lsn, self._lock = catalog, None, source_lsn, threading.RLock()
        if group:
            self.bind({"name": group})

    def _lock_name(self, group: str) -> str:
        return f"_locks/{group}"

    def bind(self, body: dict) -> dict:
        """Creates the group if need be and takes its lock: a group has one server."""
        name = body.get("name") or "default"
        with self._lock:
            if self.group:
                raise Conflict(f"this server serves group '{self.group}'")
            if not self.catalog.store.create(self._lock_name(name), "held"):
                raise Conflict(f"another server serves group '{name}'")
            if name not in self.catalog.groups:
                self.catalog.create_group(name, body.get("publication"), body.get("slot_name"), body.get("conninfo"), "daemon")
            self.group = name
            return {"group": name}

    def close(self) -> None:
        if self.group:
            self.catalog.store.delete(self._lock_name(self.group))
            self.group = None

    def bound(self) -> str:
        if not self.group:
            raise Unbound("no group is bound; POST /groups first")
        return self.group

    def mine(self, frame) -> list[dict]:
        return [json.loads(x) for x in frame.where(frame["group"] == self.bound()).toJSON().collect()]

    def route(self, method: str, path: str, body: dict, query: dict) -> dict | list:
        parts = [unquote(p) for p in path.strip("/").split("/") if p]
        c = self.catalog
        match method, parts:
            case "GET", ["health"]:
                return {"status": "ok", "group": self.group}
            case "GET", ["status"]:
                return self.mine(monitor.status(c, self.source_lsn()))
            case "GET", ["tables"]:
                return self.mine(monitor.tables(c))
            case "GET", ["metrics"]:
                return json.loads(monitor.metrics(c, self.source_lsn()))
            case "POST", ["groups"]:
                return self.bind(body)
            case "POST", ["groups", ("enable" | "disable") as what]:
                (c.enable_group if what == "enable" else c.disable_group)(self.bound())
                return {"group": self.group, "enabled": what == "enable"}
            case "DELETE", ["groups"]:
                name = self.bound()
                c.drop_group(name, drop_targets=True)
                self.close()
                return {"dropped": name}
            case "POST", ["tables"]:
                if not body.get("source_table"):
                    raise CatalogError("source_table is missing")
                m = c.add_table(body["source_table"], [(n, int(t)) for n, t in body.get("columns", [])], body.get("keys"), body.get("target_table"), self.bound(), body.get("copy_data", True), body.get("fan_in", False), body.get("sync_mode", "upsert"))
                return {"source": m.source, "target": m.target, "state": m.state}
            case "POST", ["tables", name, "resync"]:
                return {"source": c.resync_table(name, self.bound()).source, "state": "SNAPSHOT"}
            case "DELETE", ["tables", name]:
                c.remove_table(name, query.get("drop_target", ["false"])[0] == "true", self.bound())
                return {"removed": c.full(name)}
        raise NotFound(f"no route {method} {path}")


def status_of(error: Exception) -> int:
    if isinstance(error, CatalogError):
        return error.status
    return 400 if isinstance(error, ConfigError | UnsupportedType | json.JSONDecodeError | TypeError) else 500


def serve(service: Service, host: str = "127.0.0.1", port: int = 0) -> ThreadingHTTPServer:
    """A server in a thread of its own; its address is in server_address."""

    class Handler(BaseHTTPRequestHandler):
        def answer(self) -> None:
            url = urlsplit(self.path)
            try:
                raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                code, out = 200, service.route(self.command, url.path, json.loads(raw) if raw else {}, parse_qs(url.query))
            except Exception as e:
                code, out = status_of(e), {"error": str(e)}
            data = json.dumps(out).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        do_GET = do_POST = do_DELETE = answer

        def log_message(self, *args) -> None:
            pass

    server = ThreadingHTTPServer((host, port), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
