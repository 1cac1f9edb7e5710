import io
import json
import logging

import pytest

from lectern.config import EngineConfig
from lectern.errors import STATUS, ConfigError, EmbeddingAuthError, EmbeddingUnavailableError, LecternError
from lectern.functions.redact import REDACTED, driver_log, redact
from lectern.sources.embedder import HashEmbedder, ProviderEmbedder, TokenBucket, request_groups

CONFIG = EngineConfig(batch_items=2, batch_chars=10, item_chars=8)


def _provider(answers, **kw):
    """A provider that gives the answers in turn; what was sent is kept in ``sent``."""
    sent = []

    def transport(method, path, body):
        sent.append((method, path, body))
        answer = answers.pop(0) if answers else (200, {}, _vectors(len(body["input"])))
        if isinstance(answer, Exception):
            raise answer
        return answer

    embedder = ProviderEmbedder(transport, "m", sleep=lambda s: sent.append(("wait", s)), **kw)
    return embedder, sent


def _vectors(n, order=None, dim=2):
    return json.dumps({"data": [{"index": i, "embedding": [float(i)] * dim} for i in (order or range(n))]})


def test_groups_keep_to_all_caps():
    assert [list(g) for g in request_groups([4, 4, 4, 8, 1, 1, 1], CONFIG)] == [[0, 1], [2], [3, 4], [5, 6]]
    assert list(request_groups([], CONFIG)) == []
    with pytest.raises(ConfigError):
        list(request_groups([9], CONFIG))


def test_opening_checks_model_and_length():
    models = (200, {}, json.dumps({"data": [{"id": "m"}, {"id": "n"}]}))
    embedder, sent = _provider([models])
    assert embedder.open().dimension == 2 and embedder.models == ("m", "n")
    with pytest.raises(ConfigError):
        _provider([models], expected_dimension=3)[0].open()
    with pytest.raises(EmbeddingAuthError) as refused:
        _provider([(200, {}, json.dumps({"data": [{"id": "n"}]}))])[0].open()
    assert refused.value.details == {"models": ["n"]} and refused.value.status == 502
    for body in ("[]", "x", "{}"):
        with pytest.raises(EmbeddingUnavailableError):
            _provider([(200, {}, body)])[0].open()


def test_order_is_restored_only_from_a_permutation():
    assert _provider([(200, {}, _vectors(2, [1, 0]))])[0].embed(["a", "b"]) == [[0.0, 0.0], [1.0, 1.0]]
    assert _provider([(200, {}, _vectors(2, [1, 1]))])[0].embed(["a", "b"]) == [[1.0, 1.0], [1.0, 1.0]]
    for body in (_vectors(1), json.dumps({"data": [{"embedding": [1]}, {"embedding": [1, 2]}]}), json.dumps({"data": [{}, {}]})):
        with pytest.raises(EmbeddingUnavailableError):
            _provider([(200, {}, body)])[0].embed(["a", "b"])


def test_repeats_wait_and_give_up():
    embedder, sent = _provider([(429, {"Retry-After": "2"}, ""), OSError(), (503, {"Retry-After": "soon"}, "")])
    assert len(embedder.embed(["a"])) == 1 and embedder.requests == 1
    waits = [w for kind, w in (s for s in sent if len(s) == 2)]
    assert len(waits) == 3 and 1 <= waits[0] <= 2 and 0.5 <= waits[1] <= 1 and 1 <= waits[2] <= 2
    with pytest.raises(EmbeddingUnavailableError):
        _provider([(500, {}, "x")] * 5)[0].embed(["a"])
    with pytest.raises(EmbeddingUnavailableError):
        _provider([OSError()] * 5)[0].embed(["a"])
    embedder, sent = _provider([(400, {}, "no")])
    with pytest.raises(EmbeddingUnavailableError):
        embedder.embed(["a"])
    assert len(sent) == 1  # not repeated


def test_refusals_hide_the_key_and_name_the_models():
    told = json.dumps({"error": "key s3cret may not use m. Allowed models: a-1, b.2"})
    with pytest.raises(EmbeddingAuthError) as refused:
        _provider([(403, {}, told)], secrets=("s3cret",))[0].embed(["a"])
    assert "s3cret" not in str(refused.value) and refused.value.details["models"] == ["a-1", "b.2"]
    assert refused.value.envelope()["error"]["code"] == "EMBEDDING_AUTH"


def test_bucket():
    now = [0.0]
    bucket = TokenBucket(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        bucket.take()
    assert now[0] == pytest.approx(60) and bucket.waits == 2
    with pytest.raises(ConfigError):
        TokenBucket(0)


def test_hash_embedder_counts_and_agrees_with_the_column(spark):
    from pyspark.sql import functions as F

    from lectern.functions.vectors import hash_embedding

    texts = ["one two Two", "", "سلام دنیا"]
    embedder = HashEmbedder()
    want = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hash_embedding(F.col("t"))).collect()]
    assert embedder.embed(texts) == [pytest.approx(w) for w in want] and embedder.requests == 1


def test_secrets_leave_no_trace_in_the_log():
    out = io.StringIO()
    log = driver_log(["key", "key-2", None, ""], stream=out)
    log.warning("call %s with %d", "key-2", 7)
    try:
        raise ValueError("bad key")
    except ValueError:
        log.exception("failed")
    assert "key" not in out.getvalue() and "7" in out.getvalue() and len(log.handlers) == 1
    assert redact("akeyb", ["key"]) == f"a{REDACTED}b"
    logging.getLogger("lectern").handlers.clear()


def test_every_error_has_a_status():
    kinds = [LecternError, *LecternError.__subclasses__()]
    assert {k.code for k in kinds} <= set(STATUS) and all(k("x").status == STATUS[k.code] for k in kinds)
