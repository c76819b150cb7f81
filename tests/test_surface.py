import io
import json
import threading
import urllib.request

import pytest

from palimpsest import config, rpc
from palimpsest.archive import Archives
from palimpsest.errors import ConfigError


def test_config_layers(tmp_path):
    env = {"HOME": str(tmp_path)}
    assert config.load(env=env)["search"]["max_count"] == 100 and config.load(env=env)["archive_dir"] == f"{tmp_path}/archives"
    at = tmp_path / ".config" / "palimpsest" / "config.toml"
    at.parent.mkdir(parents=True)
    at.write_text("[search]\nmax_count = 7\nignore_case = true\n[scan]\nskip_directories = ['x']\n")
    got = config.load(env=env)
    assert got["search"]["max_count"] == 7 and got["search"]["ignore_case"] is True and got["scan"]["skip_directories"] == ["x"]
    env |= {"PALIMPSEST_SEARCH__MAX_COUNT": "9", "PALIMPSEST_SEARCH__IGNORE_CASE": "false", "PALIMPSEST_LOG": "debug"}
    assert config.load(env=env)["search"]["max_count"] == 9 and config.load(env=env)["search"]["ignore_case"] is False
    assert config.load({"search": {"max_count": 0}}, env)["search"]["max_count"] == 0
    assert config.DEFAULTS["search"]["max_count"] == 100


@pytest.mark.parametrize("text", ["[search]\nmax_count = 'x'", "[search]\nodd = 1", "search = 1", "[search", "[search]\nformat = 'xml'", "[search]\nmax_count = -1"])
def test_bad_config(tmp_path, text):
    path = tmp_path / "c.toml"
    path.write_text(text)
    with pytest.raises(ConfigError):
        config.load(env={"PALIMPSEST_CONFIG": str(path), "HOME": str(tmp_path)})


def test_bad_variables():
    for name, value in (("PALIMPSEST_SEARCH__MAX_COUNT", "many"), ("PALIMPSEST_SEARCH__IGNORE_CASE", "maybe")):
        with pytest.raises(ConfigError):
            config.load(env={name: value, "XDG_CONFIG_HOME": "/nowhere"})


@pytest.fixture(scope="module")
def archives(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("rpc")
    dump = root / "d" / "backend.json"
    dump.parent.mkdir()
    dump.write_text(json.dumps({"conversations": [{"conversation": {"id": "c1", "title": "First"}, "responses": [{"response": {"_id": "r1", "message": "the lizard"}}]}]}))
    a = Archives(spark, str(root / "archives"))
    rpc.call(a, "ingest", {"inputs": [str(dump.parent)], "service": "assistant", "account": "me"})
    return a


def ask(a, method, params=None, dialect="plain", **more):
    return rpc.answer(a, json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params} | more), dialect)


def test_functions(archives):
    assert ask(archives, "list_archives")["result"] == {"archives": ["assistant/me"]}
    hits = ask(archives, "search", {"pattern": "LIZARD", "ignore_case": True})["result"]["hits"]
    assert [(h["snippet"], h["occurrences"][0]["conversation_id"]) for h in hits] == [("the lizard", "c1")]
    assert ask(archives, "stats", {"service": "assistant", "account": "me"})["result"]["stats"][0]["conversations"] == 1
    assert ask(archives, "scoped_path", {"service": "s", "account": "a"})["result"]["path"].endswith("service=s/account=a")


@pytest.mark.parametrize(
    "method,params,code",
    [("nothing", None, rpc.NO_METHOD), ("search", {}, rpc.INVALID_PARAMS), ("search", {"pattern": 1}, rpc.INVALID_PARAMS), ("search", {"pattern": "x", "odd": 1}, rpc.INVALID_PARAMS), ("search", {"pattern": "x", "max_count": -1}, rpc.INVALID_PARAMS), ("search", {"pattern": "a OR"}, rpc.FAILED), ("search", [], rpc.INVALID_PARAMS), ("scoped_path", {"service": "s", "account": ".."}, rpc.FAILED), ("stats", {}, rpc.INVALID_PARAMS)],
)
def test_errors(archives, method, params, code):
    if params == []:
        params = [1]
    assert ask(archives, method, params)["error"]["code"] == code


def test_lines_and_tools(archives):
    lines = ["{", "", json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), json.dumps({"id": 1, "method": "tools/list"}), json.dumps({"id": 2, "method": "tools/call", "params": {"name": "list_archives", "arguments": {}}}), "[]", json.dumps({"id": 3, "method": "initialize"})]
    sink = io.StringIO()
    rpc.serve_lines(archives, io.StringIO("\n".join(lines)), sink)
    got = [json.loads(x) for x in sink.getvalue().splitlines()]
    assert [x.get("error", {}).get("code") for x in got] == [rpc.PARSE_ERROR, None, None, rpc.INVALID_REQUEST, None]
    assert {t["name"] for t in got[1]["result"]["tools"]} == set(rpc.FUNCTIONS) and json.loads(got[2]["result"]["content"][0]["text"]) == {"archives": ["assistant/me"]}


def test_http(archives):
    server = rpc.http_server(archives, "127.0.0.1:0")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        assert urllib.request.urlopen(f"{at}/health", timeout=10).read() == b"ok"
        post = lambda x: urllib.request.urlopen(urllib.request.Request(f"{at}/mcp", json.dumps(x).encode()), timeout=60)
        assert json.loads(post({"id": 1, "method": "ping"}).read())["result"] == {}
        assert post({"method": "ping"}).status == 204
    finally:
        server.shutdown()
        server.server_close()


def test_every_function_tells_its_parameters(spark, tmp_path):
    """A schema for each, and what it says is what is taken: unknown names and missing ones are errors."""
    from palimpsest.archive import Archives

    a = Archives(spark, str(tmp_path))
    assert set(rpc.PARAMS) == set(rpc.FUNCTIONS)
    assert rpc.schema("search")["required"] == ["pattern"] and rpc.schema("search")["properties"]["max_count"] == {"type": "integer", "minimum": 0}
    assert rpc.schema("ingest")["properties"]["inputs"] == {"type": "array", "items": {"type": "string"}} and "required" not in rpc.schema("ingest")
    for name, (_, needed) in rpc.PARAMS.items():
        assert rpc.schema(name)["additionalProperties"] is False
        for bad in ([{"other": 1}] + [{}] * bool(needed)):
            with pytest.raises(rpc.RpcError):
                rpc.call(a, name, bad)
