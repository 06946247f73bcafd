import json
import threading
from http.client import HTTPConnection

import pytest

from tidewell.server import make_server


@pytest.fixture(scope="module")
def call(spark, tmp_path_factory):
    server = make_server(spark, f"file://{tmp_path_factory.mktemp('served')}", port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def send(method, path, body=None):
        connection = HTTPConnection(*server.server_address, timeout=120)
        connection.request(method, path, body)
        answer = connection.getresponse()
        data = answer.read().decode()
        connection.close()
        return answer.status, data

    yield send
    server.shutdown()


def test_series(call):
    body = json.dumps({"entries": [{"ts": t, "value": v} for t, v in ((1000, 7), (1600, 9.25), (2500, -3))]})
    query = "/series/t?from=1970-01-01&group_by=hour&aggregators=mean,max&limit=10"
    assert call("POST", "/series/t", body)[0] == 404
    assert call("GET", query)[0] == 404
    assert call("PUT", "/series/t") == (201, "") and call("PUT", "/series/t")[0] == 201
    assert call("GET", query) == (200, '{"rows":[]}')
    assert call("POST", "/series/t", body)[0] == 200
    for bad in ('{"entries":[{"ts":', "[]", '{"entries":[{"ts":1,"value":"x"}]}', '{"entries":[{"ts":1,"value":NaN}]}'):
        status, text = call("POST", "/series/t", bad)
        assert status == 400 and json.loads(text) == {"code": 400, "message": "invalid json body"}
    status, text = call("GET", query)
    assert json.loads(text) == {"rows": [{"timestamp": "1970-01-01T00:00:00+00:00", "values": [{"Mean": (7 + 9.25 - 3) / 3}, {"Max": 9.25}]}]}
    assert call("GET", query.replace("hour", "week"))[0] == 400
    assert call("GET", "/series/t?from=0&group_by=day&aggregators=mean")[0] == 400
    assert call("GET", "/series/none?from=x")[0] == 404
    assert call("GET", "/elsewhere")[0] == 404
    assert call("PUT", "/series/a%2Fb")[0] == 400


def test_export_and_restore(call):
    assert call("GET", "/series/none/export")[0] == 404
    assert call("POST", "/series/r/restore", "40; 0.75\n95; 6\n")[0] == 200
    assert call("GET", "/series/r/export") == (200, "40; 0.75\n95; 6.00\n")
    status, text = call("POST", "/series/r/restore", "40; 0.75\n")
    assert status == 409 and json.loads(text)["code"] == 409
    assert call("POST", "/series/s/restore", "no line\n")[0] == 400
    assert call("GET", "/series/s/export")[0] == 404


def test_bodies_in_chunks(call):
    blocks = lambda: iter([b"100; 1\n20", b"0; 2.5\n", b"300; 4\n"])
    assert call("POST", "/series/chunked/restore", blocks())[0] == 200
    assert call("GET", "/series/chunked/export") == (200, "100; 1.00\n200; 2.50\n300; 4.00\n")
    assert call("PUT", "/series/more")[0] == 201
    assert call("POST", "/series/more", iter([b'{"entries":[{"ts":5,', b'"value":2}]}']))[0] == 200
    assert call("GET", "/series/more/export") == (200, "5; 2.00\n")
