"""A transport and a local board server for the tests of the sources."""

import json
import threading
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer


def fetch(method: str, url: str, body: str | None, headers: dict, timeout: float) -> tuple[int, str]:
    """A board "short" has 45 postings; "bad" does not answer."""
    if "bad" in url:
        raise OSError("no such board")
    if body is None or "offset" not in body:
        return 200, f"{method} {url}"
    at = json.loads(body)["offset"]
    return 200, json.dumps({"jobPostings": [{"title": f"t{i}"} for i in range(at, min(at + 20, 45))]})


class Boards:
    """What the server was asked, and what fails: paths, or (path, offset), with the number of answers that do."""

    def __init__(self):
        self.asked, self.failing, self.sizes = [], {}, {"small": 7, "even": 40, "large": 600}


@contextmanager
def board_server():
    told = Boards()

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, body):
            site, at = self.path.split("?")[0].strip("/").split("/")[-2], json.loads(body).get("offset", 0) if body else 0
            told.asked.append((self.command, self.path, at, self.headers["User-Agent"], self.headers["Content-Type"]))
            for key in (self.path, (site, at)):
                if told.failing.get(key, 0) > 0:
                    told.failing[key] -= 1
                    return self._send(503, "busy")
            if site not in told.sizes:
                return self._send(404, "none")
            n = told.sizes[site]
            return self._send(200, json.dumps({"total": n, "jobPostings": [{"title": f"{site} {i}", "externalPath": f"/job/{i}", "bulletFields": [f"{site}-{i}"]} for i in range(at, min(at + 20, n))]}))

        def _send(self, status, text):
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._answer(None)

        def do_POST(self):
            self._answer(self.rfile.read(int(self.headers["Content-Length"])).decode())

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        told.base = f"http://127.0.0.1:{server.server_port}"
        yield told
    finally:
        server.shutdown()
