"""The stored-table operations, from creation to export, and their interruptions."""

import json
from datetime import datetime

import pytest

from lodestone import fixtures as fx
from lodestone.plans import service as services
from lodestone.plans.service import Service
from lodestone.plans.spec import CareerSpec, CrawlSpec, MatchSpec, NotFound, ValidationError


def service(spark, tmp_path, **more):
    return Service(spark, f"file://{tmp_path}/engine", clock=lambda: datetime(2024, 5, 1), **{"lookup": fx.lookup, **more})


def test_scan_from_creation_to_export(spark, tmp_path):
    s = service(spark, tmp_path)
    assert s.jobs().count() == 0
    job = s.create(CareerSpec("http://site.example/careers", max_pages=10, max_depth=2))
    assert s.get(job).first()["status"] == "QUEUED"
    assert [(r["canonical_url"], r["status"]) for r in s.frontier(job).collect()] == [("http://site.example/careers", "PENDING")]
    assert s.control(job, "pause") == "PAUSED" and s.control(job, "resume") == "QUEUED"
    with pytest.raises(ValidationError):
        s.control(job, "resume")
    assert s.run(job, fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark)) == "COMPLETED"
    row = s.scan(job).first()
    assert (row["status"], row["postings"], row["pages_crawled"], row["pages_failed"]) == ("COMPLETED", 1, 2, 0)
    assert {r["status"] for r in s.frontier(job).collect()} == {"DONE"}
    assert [r["title"] for r in s.pages(job).collect()] == ["Careers", "Job"]
    csv = bytes(s.download(job, "csv").first()["payload"]).decode()
    assert csv.startswith("title,company") and '"Java | AWS | Terraform | Kafka"' in csv and csv.endswith("\r\n")
    assert json.loads(bytes(s.download(job, "json").first()["payload"]))[0]["title"] == "Dock Software Architect"
    report = s.match(job, MatchSpec("I know Java, Kafka and AWS well. " * 4))
    assert [r["score"] for r in report.matches.collect()] == [80]
    with pytest.raises(ValidationError):
        s.control(job, "cancel")
    with pytest.raises(NotFound):
        s.get("nobody")


def test_plain_crawl_is_no_scan(spark, tmp_path):
    s = service(spark, tmp_path)
    job = s.create(CrawlSpec("http://site.example/"))
    assert s.control(job, "cancel") == "CANCELLED"
    assert s.run(job, fx.SITE.frame(spark)) == "CANCELLED"
    with pytest.raises(NotFound):
        s.scan(job)


def test_private_seed_makes_no_job(spark, tmp_path):
    s = service(spark, tmp_path)
    with pytest.raises(ValidationError):
        s.create(CrawlSpec("http://192.168.0.1/"))
    assert s.jobs().count() == 0
    assert service(spark, tmp_path, allow_private=True).create(CrawlSpec("http://192.168.0.1/"))


class Acting(services.StoreKeeper):
    """Does something before the second round."""

    rounds, act = 0, None

    def status(self):
        Acting.rounds += 1
        if Acting.rounds == 2:
            Acting.act(self.service, self.job_id)
        return super().status()


def interrupted(monkeypatch, act):
    Acting.rounds, Acting.act = 0, staticmethod(act)
    monkeypatch.setattr(services, "StoreKeeper", Acting)


def test_pause_while_running_and_resume(spark, tmp_path, monkeypatch):
    s = service(spark, tmp_path)
    job = s.create(CrawlSpec("http://site.example/", max_pages=10, max_depth=2))
    interrupted(monkeypatch, lambda s, job: s.control(job, "pause"))
    assert s.run(job, fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark)) == "PAUSED"
    assert s.get(job).first()["pages_crawled"] == 1  # what was fetched is kept
    assert sorted(r["status"] for r in s.frontier(job).collect()) == ["DONE", "PENDING", "PENDING"]
    assert s.control(job, "resume") == "QUEUED"
    assert s.run(job, fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark)) == "COMPLETED"
    assert sorted(r["url"] for r in s.pages(job).collect()) == sorted(r[0] for r in fx.SITE_PAGES.rows)
    assert all(r["attempts"] == 1 for r in s.frontier(job).collect())  # nothing was asked twice


def test_interrupt_pauses_and_error_fails(spark, tmp_path, monkeypatch):
    def stop(s, job):
        raise KeyboardInterrupt

    def fall(s, job):
        raise RuntimeError("disk is gone")

    s = service(spark, tmp_path)
    job = s.create(CrawlSpec("http://site.example/", max_pages=10, max_depth=1))
    interrupted(monkeypatch, stop)
    with pytest.raises(KeyboardInterrupt):
        s.run(job, fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark))
    row = s.get(job).first()
    assert (row["status"], row["pages_crawled"], row["error_message"]) == ("PAUSED", 1, "Worker interrupted; safe to resume")
    interrupted(monkeypatch, fall)
    with pytest.raises(RuntimeError):
        s.run(job, fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark))
    row = s.get(job).first()
    assert (row["status"], row["pages_crawled"], row["error_message"]) == ("FAILED", 3, "disk is gone")


def test_recovery_asks_again_for_what_was_being_fetched(spark, tmp_path):
    s = service(spark, tmp_path)
    job = s.create(CrawlSpec("http://site.example/", max_depth=0))
    claimed = services.fr.claim(s.frontier(job), services.F.lit(datetime(2024, 6, 1)))
    s._put_frontier(job, claimed)  # the process dies here
    assert [r["status"] for r in s.frontier(job).collect()] == ["FETCHING"]
    (done,) = s.recover(fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark))
    assert done.result(timeout=120) == "COMPLETED"
    (row,) = s.frontier(job).collect()
    assert (row["status"], row["attempts"]) == ("DONE", 2)


def test_one_worker_a_job(spark, tmp_path, monkeypatch):
    s = service(spark, tmp_path)
    job = s.create(CrawlSpec("http://site.example/", max_depth=1))
    inner = []
    interrupted(monkeypatch, lambda s, job: inner.append(s.run(job, None)))  # a second worker, while the first works
    assert s.run(job, fx.SITE.frame(spark), fx.SITE_ROBOTS.frame(spark)) == "COMPLETED"
    assert inner == ["RUNNING"]
