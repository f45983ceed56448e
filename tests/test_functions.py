"""Rules without Spark, and Spark forms against sequential models."""

import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lodestone import fixtures as fx
from lodestone.functions import html, postings, urls
from lodestone.operators import matching, schedule
from lodestone.plans.spec import CareerSpec, CrawlSpec, MatchSpec, ValidationError, capabilities


def test_canonical_text():
    for _, base, raw, want in fx.RELATIVE.rows:
        assert urls.canonical_text(base, raw) == want, (base, raw)


def test_percent_grows_again():
    once = urls.canonical_text(None, "http://a.example/x%20y")
    assert urls.canonical_text(None, once) == "http://a.example/x%252520y"


@given(st.text(max_size=40))
def test_canonical_text_never_raises(text):
    found = urls.canonical_text("http://a.example/x/y", text)
    assert found is None or found.startswith(("http://", "https://"))


@given(st.lists(st.sampled_from(["a", ".", "..", "", "b"]), max_size=8))
def test_no_dots_are_left(parts):
    out = urls.without_dots("/" + "/".join(parts)).split("/")
    inner = [p for p in out if p]
    while inner and inner[0] == "..":
        inner.pop(0)
    assert "." not in inner and ".." not in inner


def test_seed_must_be_absolute():
    with pytest.raises(ValueError):
        urls.canonical_seed("/relative")


def test_json_text():
    assert postings.joined_text({"@type": "Country", "b": ["US", None, {"x": True}]}) == "Country, US, true"
    assert postings.postings_in({"@graph": [{"@type": "jobPosting", "@graph": {"@type": ["x", "JOBPOSTING"]}}]})[1]["@type"] == ["x", "JOBPOSTING"]
    assert postings.location_of({}) == "Not specified"


def test_clean_html_twice():
    assert html.clean_html("&lt;p&gt;a &amp;amp; b&lt;/p&gt;") == "a & b"
    assert html.clean_html("1 < 2") == "1 < 2"


def test_bounds():
    assert CrawlSpec("HTTP://A.example").seed_url == "http://a.example/"
    for bad in ({"max_pages": 0}, {"max_pages": 501}, {"max_depth": 11}, {"requests_per_second": 0.05}):
        with pytest.raises(ValidationError) as e:
            CrawlSpec("http://a.example", **bad)
        assert set(e.value.fields) == set(bad)
    with pytest.raises(ValidationError):
        CareerSpec("http://a.example", max_pages=201)
    with pytest.raises(ValidationError):
        MatchSpec("short")
    assert capabilities()["aiConfigured"] is False


def test_limiter_against_a_loop(spark):
    rng = random.Random(5)
    rows = [(i, rng.randrange(5), rng.randrange(10**7), rng.choice([1, 10**5, 10**6])) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, o int, t long, step long")
    got = {r["id"]: r["slot_us"] for r in schedule.slots(df, "o", "t", "step", ["t", "id"]).collect()}
    free = {}
    for i, o, t, step in sorted(rows, key=lambda r: (r[2], r[0])):
        slot = max(t, free.get(o, t))
        free[o] = slot + step
        assert got[i] == slot


RESUME = "Java, Kafka and SQL " * 8


def test_matching_modes(spark):
    jobs = fx.JOBS.frame(spark)
    assert matching.match(jobs, RESUME).notice == matching.NOTICES["off"]
    off = matching.match(jobs, RESUME, use_ai=True)
    assert (off.method, off.ai_used, off.notice) == ("DETERMINISTIC", False, matching.NOTICES["unconfigured"])
    scores = [r["score"] for r in off.matches.collect()]
    assert scores == sorted(scores, reverse=True)

    def broken(payload):
        raise OSError("no network")

    failed = matching.match(jobs, RESUME, use_ai=True, ask=broken)
    assert (failed.ai_used, failed.notice) == (False, matching.NOTICES["failed"])

    def answer(payload):
        import json

        assert payload["store"] is False and payload["max_output_tokens"] == 3000
        text = json.dumps({"matches": [{"jobId": "job-01", "score": 300, "matchedSkills": [], "missingSkills": [], "summary": ""}]})
        return json.dumps({"output": [{"content": [{"type": "output_text", "text": text}]}]})

    used = matching.match(jobs, RESUME, use_ai=True, ask=answer, model="m")
    assert (used.method, used.ai_used) == ("OPENAI:m", True)
    assert [(r["id"], r["score"]) for r in used.matches.collect()] == [("job-01", 100)]
