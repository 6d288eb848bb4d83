import json
import threading
import urllib.error
import urllib.request

from factflow import service


def ask(port, verb, path, body=None):
    request = urllib.request.Request(f"http://127.0.0.1:{port}{path}", method=verb, data=json.dumps(body).encode() if body is not None else None)
    try:
        with urllib.request.urlopen(request) as r:
            raw = r.read().decode()
            return r.status, json.loads(raw) if r.headers["Content-Type"] == "application/json" else raw
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_http_and_lines(spark, tmp_path):
    p = tmp_path / "project"
    p.mkdir()
    (p / "A.java").write_text('package t; @RestController public class A { @GetMapping("/x") public String f(String k) { B b = new B(); String r = b.g(k); return r; } }')
    (p / "B.java").write_text("package t; public class B { public String g(String k) { return k; } }")
    now = [0.0]
    manager = service.Manager(spark, f"file://{tmp_path}/root", idle_after=100, clock=lambda: now[0])
    server = service.http_server(manager)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    port = server.server_address[1]
    try:
        assert ask(port, "GET", "/health") == (200, "OK")
        assert ask(port, "POST", "/api/workspaces", {"name": "", "project_path": "x"})[0] == 400 and ask(port, "GET", "/none")[0] == 404
        status, made = ask(port, "POST", "/api/workspaces", {"name": "n", "project_path": f"file://{p}"})
        assert status == 200 and made["status"] == "loaded" and ask(port, "GET", "/api/workspaces") == (200, [made])
        base = f"/api/workspaces/{made['id']}"
        assert ask(port, "GET", f"{base}/call-graph?method=A.f&direction=outgoing")[1] == {"edges": [{"caller": "t.A.f", "callee": "t.B.g", "is_virtual": True}]}
        assert ask(port, "GET", f"{base}/routes?path=/x")[1]["routes"][0]["http_method"] == "GET" and ask(port, "GET", f"{base}/routes?path=/y")[1] == {"routes": []}
        found = ask(port, "GET", f"{base}/lineage?node=A.f(java.lang.String)%23k&direction=downstream")[1]
        assert {"from", "to", "type"} == set(found["edges"][0]) and "p0" in found["nodes"]
        assert ask(port, "GET", f"{base}/call-graph?method=A.f")[0] == 400
        # idle after a while, loaded by the next question; unloaded ones wait for a start
        now[0] = 101
        assert ask(port, "GET", "/api/workspaces")[1][0]["status"] == "idle"
        assert ask(port, "GET", f"{base}/routes")[0] == 200 and manager.list()[0].status == "loaded"
        assert ask(port, "POST", f"{base}/stop")[1]["status"] == "unloaded" and ask(port, "GET", f"{base}/routes")[0] == 400
        assert ask(port, "POST", f"{base}/start")[1]["status"] == "loaded"

        line = lambda **x: service.handle_line(manager, json.dumps({"jsonrpc": "2.0", "id": 1, **x}))
        call = lambda name, **a: line(method="tools/call", params={"name": name, "arguments": a})
        assert line(method="initialize")["result"]["capabilities"] == {"tools": {}} and len(line(method="tools/list")["result"]["tools"]) == 8
        text = call("query_call_graph", workspace_id=made["id"], method="g", direction="incoming")["result"]["content"][0]["text"]
        assert json.loads(text)["edges"][0]["caller"] == "t.A.f"
        assert [line(method="x")["error"]["code"], line(method="tools/call")["error"]["code"], call("none")["error"]["code"], call("workspace_start", id="?")["error"]["code"]] == [-32601, -32602, -32603, -32603]
        assert service.handle_line(manager, "{")["error"]["code"] == -32700 and service.handle_line(manager, '{"method": "initialize"}') is None
        said = []
        service.serve_lines(manager, ["\n", '{"id": 2, "method": "tools/list"}\n'], said.append)
        assert len(said) == 1
        assert json.loads(call("workspace_delete", id=made["id"])["result"]["content"][0]["text"]) == {"success": True}
        assert ask(port, "DELETE", base) == (200, {"success": False}) and not (tmp_path / "root" / made["id"]).exists()
    finally:
        server.shutdown()
