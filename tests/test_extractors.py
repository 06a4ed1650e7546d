import json

from loomgraph.streaming import extractors


def test_rate_limiter():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    r = extractors.RateLimiter(2, 60, lambda: now[0], sleep)
    for _ in range(5):
        r.acquire()
    assert slept == [60.0, 60.0]
    extractors.RateLimiter(0, sleep=sleep).acquire()


def test_model_and_fallback(spark):
    def call(text):
        if "fatal" in text:
            raise RuntimeError("401 unauthorized")
        if "malformed" in text:
            return json.dumps([{"skill": "x", "weight": 99, "context": "c"}])
        return json.dumps({"skills": [{"skill": "Docker", "weight": 1.5, "context": text}]})

    chunks = spark.createDataFrame([("a", 0, "good"), ("a", 1, "fatal React"), ("b", 0, "malformed Docker")], "source_id string, index int, text string")
    nodes = spark.createDataFrame([("Docker",), ("React",)], "name string")
    got = {(r["source_id"], r["index"]): r for r in extractors.model_extractor(call)(chunks, nodes).collect()}
    assert got["a", 0]["skill"] == "Docker" and got["a", 1]["error"].startswith("RuntimeError") and got["b", 0]["error"] == "malformed payload"
    both = extractors.with_fallback(extractors.model_extractor(call))(chunks, nodes)
    assert {(r["source_id"], r["index"], r["skill"]) for r in both.collect()} == {("a", 0, "Docker"), ("a", 1, "React"), ("b", 0, "Docker")}
