"""Serving of fitted models over HTTP, rotating checkpoints, and serializer objects."""

from __future__ import annotations

import json
import threading
import time
from collections import OrderedDict
from dataclasses import dataclass
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import SparkSession

from .workflow import load_model, load_model_info, save_model


@dataclass
class ModelSerializer:
    """Folders of :func:`millrace.plans.workflow.save_model`."""

    format: str = "folder"

    def save(self, model, path: str, metadata: dict | None = None) -> None:
        save_model(model, path, metadata)

    def load(self, path: str):
        return load_model(path)

    def info(self, path: str) -> dict:
        return load_model_info(path)


class ModelCheckpoint:
    """Keeps the ``max_to_keep`` latest (or best) of the models given to it."""

    def __init__(self, directory: str, prefix: str = "checkpoint", max_to_keep: int = 5, save_best_only: bool = False, monitor: str = "score", mode: str = "max"):
        self.directory, self.prefix, self.most, self.best_only, self.monitor = directory, prefix, max_to_keep, save_best_only, monitor
        self.sign, self.kept, self.count = 1 if mode == "max" else -1, [], 0

    def _drop(self, path: str) -> None:
        jvm = SparkSession.active()._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(SparkSession.active()._jsc.hadoopConfiguration()).delete(p, True)

    def update(self, model, metrics: dict | None = None) -> str | None:
        value = self.sign * (metrics or {}).get(self.monitor, 0.0)
        if self.best_only and self.kept and value <= max(v for v, _ in self.kept):
            return None
        path = f"{self.directory.rstrip('/')}/{self.prefix}-{self.count:06d}"
        self.count += 1
        save_model(model, path, {"metrics": metrics or {}})
        self.kept.append((value, path))
        while len(self.kept) > self.most:
            worst = min(self.kept) if self.best_only else self.kept[0]
            self.kept.remove(worst)
            self._drop(worst[1])
        return path

    @property
    def best(self) -> str | None:
        return max(self.kept)[1] if self.kept else None


class ModelManager:
    """At most ``max_models`` models by name; the one unused for longest goes."""

    def __init__(self, max_models: int = 10):
        self.most, self.models, self.lock = max_models, OrderedDict(), threading.RLock()

    def add(self, name: str, model) -> None:
        with self.lock:
            self.models[name] = load_model(model) if isinstance(model, str) else model
            self.models.move_to_end(name)
            while len(self.models) > self.most:
                self.models.popitem(last=False)

    def get(self, name: str):
        with self.lock:
            self.models.move_to_end(name)
            return self.models[name]

    def names(self) -> list[str]:
        with self.lock:
            return list(self.models)


class ModelServer:
    """GET /health, /stats, /models; POST /models/{name}/predict with {"rows": [{column: value}]}, of bounded length."""

    def __init__(self, max_models: int = 10, title: str = "model server", version: str = "1.0.0", max_rows: int = 10_000):
        self.manager, self.title, self.version, self.max_rows = ModelManager(max_models), title, version, max_rows
        self.began, self.requests, self.httpd = time.time(), 0, None

    def predict(self, name: str, rows: list[dict]) -> list:
        if len(rows) > self.max_rows:
            raise ValueError(f"more than {self.max_rows} rows; use predict() on a table")
        df = SparkSession.active().createDataFrame([{**r, "_nth": i} for i, r in enumerate(rows)])
        if "row_id" not in df.columns:
            df = df.withColumn("row_id", df["_nth"])
        out = {r["_nth"]: r["prediction"] for r in self.manager.get(name).predict(df).select("_nth", "prediction").collect()}
        return [out.get(i) for i in range(len(rows))]

    def handle(self, method: str, path: str, body: bytes) -> tuple[int, dict]:
        self.requests += 1
        parts = [p for p in path.split("/") if p]
        try:
            if method == "GET" and parts == ["health"]:
                return 200, {"status": "ok", "title": self.title, "version": self.version}
            if method == "GET" and parts == ["stats"]:
                return 200, {"requests": self.requests, "uptime": time.time() - self.began, "models": len(self.manager.names())}
            if method == "GET" and parts == ["models"]:
                return 200, {"models": self.manager.names()}
            if method == "POST" and parts[:1] == ["models"] and parts[2:] == ["predict"]:
                return 200, {"predictions": self.predict(parts[1], json.loads(body)["rows"])}
        except KeyError as e:
            return 404, {"error": f"not found: {e}"}
        except ValueError as e:
            return 400, {"error": str(e)}
        return 404, {"error": "no such path"}

    def start(self, host: str = "127.0.0.1", port: int = 8000, background: bool = True) -> int:
        server = self

        class Handler(BaseHTTPRequestHandler):
            def _run(self):
                body = self.rfile.read(int(self.headers.get("Content-Length") or 0))
                code, out = server.handle(self.command, self.path, body)
                data = json.dumps(out, default=str).encode()
                self.send_response(code)
                self.send_header("Content-Type", "application/json")
                self.end_headers()
                self.wfile.write(data)

            do_GET = do_POST = _run

            def log_message(self, *args):
                pass

        self.httpd = ThreadingHTTPServer((host, port), Handler)
        if background:
            threading.Thread(target=self.httpd.serve_forever, daemon=True).start()
        else:
            self.httpd.serve_forever()
        return self.httpd.server_address[1]

    def stop(self) -> None:
        if self.httpd:
            self.httpd.shutdown()
            self.httpd.server_close()
            self.httpd = None


_SERVERS: dict[str, ModelServer] = {}


def serve(model, host: str = "127.0.0.1", port: int = 8000, model_id: str = "default", background: bool = True) -> str:
    s = ModelServer()
    s.manager.add(model_id, model)
    bound = s.start(host, port, background)
    key = f"{host}:{bound}"
    _SERVERS[key] = s
    return key


def stop_server(server_id: str | None = None) -> None:
    for k in [server_id] if server_id else list(_SERVERS):
        _SERVERS.pop(k).stop()


def server_status() -> dict:
    return {k: {"models": s.manager.names(), "requests": s.requests} for k, s in _SERVERS.items()}
