"""Small tables for the rules that no driver table exercises.

The same rows make a Spark table and a DuckDB ``VALUES`` list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

AGENT = "lodestone/1.0"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return str(x)
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(literal(i) for i in x) + "]"
    return "'" + str(x).replace("'", "''") + "'"


def lookup(host: str) -> list[str]:
    """One public address for every made-up host."""
    return ["93.184.216.34"]


class Fixture:
    """Rows with a Spark schema, usable from both engines."""

    def __init__(self, schema: str, rows: Sequence[tuple]):
        self.schema, self.rows = schema, list(rows)
        self.columns = [c.strip().split(" ")[0] for c in schema.split(",")]

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.schema)

    def sql(self, name: str = "v") -> str:
        kinds = {"int": "INTEGER", "long": "BIGINT", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE", "timestamp": "TIMESTAMP", "array<string>": "VARCHAR[]"}
        casts = ", ".join(f"CAST({c.strip().split(' ')[0]} AS {kinds[c.strip().split(' ', 1)[1]]}) AS {c.strip().split(' ')[0]}" for c in self.schema.split(","))
        body = ", ".join("(" + ", ".join(literal(x) for x in r) + ")" for r in self.rows)
        return f"(SELECT {casts} FROM (VALUES {body}) AS t({', '.join(self.columns)})) AS {name}"

    def select(self) -> str:
        """An oracle that is the rows themselves."""
        return f"SELECT {', '.join(self.columns)} FROM {self.sql()}"


RELATIVE = Fixture(
    "id int, base string, raw string, canonical string",
    [
        (1, None, "HTTP://Shop.Example.ORG:80/x/y/../../list?utm_campaign=spring&z=9&c=3#top", "http://shop.example.org/list?c=3&z=9"),
        (2, "https://docs.example.org/manual/ch1", "../faq?topic=units", "https://docs.example.org/faq?topic=units"),
        (3, None, "mailto:desk@example.org", None),
        (4, None, "javascript:void(0)", None),
        (5, None, "https://me:pw@example.org/inner", None),
        (6, "https://example.com/a/b", "?x=1", "https://example.com/a/?x=1"),
        (7, None, "https://example.com/a%20b", "https://example.com/a%2520b"),
        (8, "https://example.com/a/b", "c d", None),
        (9, "https://example.com/a/b", "c|d", None),
        (10, None, "https://example.com/../x", "https://example.com/../x"),
        (11, None, "https://exämple.com/", None),
        (12, None, "https://under_score.example.com/", None),
        (13, "https://example.com/é/x", "ü", "https://example.com/é/ü"),
        (14, "http://example.com:80/p", "//other.example.com/q", "http://other.example.com/q"),
        (15, "http://example.com/p", "https://example.com:8443", "https://example.com:8443/"),
        (16, "http://example.com/p/q?z=1", "#part", "http://example.com/p/q?z=1"),
        (17, None, "   ", None),
        (18, None, "http://example.com/a//b/./c/", "http://example.com/a/b/c/"),
        (19, None, "http://example.com/?ref=1&REF_SRC=2&Utm_x=3&gclid=4", "http://example.com/"),
        (20, None, "http://example.com/?b=2&a=1&b=2&&B=1", "http://example.com/?B=1&a=1&b=2&b=2"),
        (21, None, "ftp://example.com/file", None),
        (22, None, "/no/base", None),
    ],
)

PORTS = Fixture(
    "id int, url string",
    [(1, "https://tools.example.org/a"), (2, "https://tools.example.org:443/b"), (3, "https://tools.example.org:9443/b"), (4, "http://example.com/x?y=1#z"), (5, "http://EXAMPLE.com:80"), (6, "https://www.example.com/?q"), (7, "http://sub.example.com:8080/a/b"), (8, "nonsense")],
)

HOSTS = Fixture(
    "id int, a string, b string",
    [
        (1, "https://norwind.org/team", "https://www.norwind.org/team"), (2, "https://norwind.org/", "https://talent.norwind.org/list"), (3, "https://talent.norwind.org:8443/", "https://norwind.org/"),
        (4, "https://norwind.org/", "https://badnorwind.org/"), (5, "https://norwind.org/", "https://apply.workable.com/norwind"), (6, "https://norwind.org/", "https://notworkable.com/"),
        (7, "http://tools.example.org/a", "https://tools.example.org:80/b"), (8, "https://example.com/", "https://EXAMPLE.com:443/"), (9, "https://a.b.com/", "https://b.com.evil.net/"), (10, "https://lever.co/x", "https://jobs.lever.co/y"),
    ],
)

CAREER_LINKS = Fixture(
    "id int, seed string, cur string, candidate string, anchor string, follow boolean, redirect boolean",
    [
        (i, "https://norwind.org/team/open", "https://norwind.org/team/open", *row)
        for i, row in enumerate(
            [
                ("https://norwind.org/positions/night-shift", "More", True, True), ("https://talent.norwind.org/list/4", "Apply here", True, True), ("https://norwind.org/catalogue/lamp", "Lamp", False, True),
                ("https://apply.workable.com/norwind/job/4", "Details", True, True), ("https://clicks.example/job/4", "Details", False, False), ("https://notworkable.com/job/4", "Details", False, False),
                ("https://www.norwind.org/team/careers", None, True, True), ("https://norwind.org/about?tab=opportunity", "Us", True, True), ("https://norwind.org/jo%62/1", "x", True, True), ("mailto:jobs@norwind.org", "jobs", False, False),
                ("https://norwind.org/people", "Open position", True, True),
            ],
            1,
        )
    ],
)

ADDRESSES = Fixture(
    "id int, ip string",
    list(
        enumerate(
            [
                "127.0.0.1", "10.0.0.5", "93.184.216.34", "0.0.0.0", "169.254.1.1", "172.16.0.1", "172.32.0.1", "192.168.1.1", "224.0.0.1", "239.255.255.255", "8.8.8.8", "100.64.0.1", "198.18.0.1", "240.0.0.1", "0.1.2.3",
                "::", "::1", "fe80::1", "fec0::1", "ff02::1", "fc00::1", "2001:db8::1", "::ffff:10.0.0.1", "::ffff:8.8.8.8", "example.com",
            ],
            1,
        )
    ),
)

ROBOTS_FILES = Fixture(
    "origin string, status int, body string",
    [
        ("https://a.example", 200, "User-agent: *\nDisallow: /private\nAllow: /private/public\n"),
        ("https://b.example", 200, "User-agent: *\nDisallow: /public\nUser-agent: lodestone\nAllow: /public\nDisallow: /internal\nCrawl-delay: 1.5\n"),
        ("https://c.example", 200, "User-agent: *\nCrawl-delay: 0.25\nDisallow: /*.pdf$\n"),
        ("https://d.example", 503, "User-agent: *\nAllow: /\n"),
        ("https://e.example", 404, "User-agent: *\nDisallow: /\n"),
        ("https://f.example", 429, None),
        ("https://g.example", None, None),
        ("https://h.example", 200, "# only a comment\nDisallow: /lost\nUser-agent: other\nUser-agent: *\nSitemap: https://h.example/s.xml\nDisallow:\nCrawl-delay: x\nAllow: /same\nDisallow: /same\nDisallow: /q?a=(1)\n"),
        ("https://i.example", 200, "user-AGENT : stone # tail\r\nDISALLOW : /x\r\nCrawl-delay: 2\r\nUser-agent: lode\r\nCrawl-delay: 7\r\nDisallow: /y*z\r\n"),
        ("https://j.example", 301, "User-agent: *\nDisallow: /\n"),
    ],
)

ROBOTS_REQUESTS = Fixture(
    "id int, url string, allowed boolean",
    [
        (1, "https://a.example/private/report", False), (2, "https://a.example/private/public/index.html", True), (3, "https://a.example", True),
        (4, "https://b.example/public", True), (5, "https://b.example/internal", False), (6, "https://b.example/other", True),
        (7, "https://c.example/files/guide.pdf", False), (8, "https://c.example/files/guide.pdf?download=1", True), (9, "https://d.example/x", False), (10, "https://e.example/x", True),
        (11, "https://f.example/x", False), (12, "https://g.example/x", False), (13, "https://h.example/same", True), (14, "https://h.example/lost", True), (15, "https://h.example/q?a=(1)&b=2", False),
        (16, "https://i.example/x", False), (17, "https://i.example/y/1/z/2", False), (18, "https://i.example/y", True), (19, "https://j.example/x", True), (20, "https://k.example/x", True),
    ],
)

ROBOTS_DELAYS = Fixture("origin string, delay_ms long", [("https://b.example", 1500), ("https://c.example", 250), ("https://i.example", 7000)])

ROBOTS_RULES = Fixture(
    "origin string, allow boolean, path string, specificity int",
    [
        ("https://a.example", False, "/private", 8), ("https://a.example", True, "/private/public", 15), ("https://b.example", True, "/public", 7), ("https://b.example", False, "/internal", 9),
        ("https://c.example", False, "/*.pdf$", 5), ("https://h.example", True, "/same", 5), ("https://h.example", False, "/same", 5), ("https://h.example", False, "/q?a=(1)", 8),
        ("https://i.example", False, "/x", 2), ("https://i.example", False, "/y*z", 3),
        ("https://d.example", True, "/", 1), ("https://e.example", False, "/", 1), ("https://j.example", False, "/", 1),
    ],
)

RESPONSES = Fixture(
    "id int, status int, content_type string, attempts int, retry_after string, error string",
    [
        (1, 200, "text/html; charset=utf-8", 1, None, None), (2, 200, "application/pdf", 1, None, None), (3, 200, None, 1, None, None), (4, 503, "text/html", 1, "30", None), (5, 503, "text/html", 3, "30", None),
        (6, 429, "text/html", 2, "Wed, 21 Oct 2015 07:28:00 GMT", None), (7, 404, "text/html", 1, None, None), (8, 301, "text/html", 1, None, None), (9, 204, "APPLICATION/XHTML+XML", 1, None, None), (10, 408, None, 1, " 5 ", None),
        (11, 425, None, 2, "-7", None), (12, None, None, 1, None, "blocked"), (13, None, None, 1, None, "io"), (14, None, None, 3, None, "io"), (15, None, None, 1, None, "illegal_argument"), (16, None, None, 2, "9", "retryable"),
        (17, None, None, 1, None, "unsafe"), (18, 500, "text/html", 2, "3600", None),
    ],
)

TEXTS = Fixture(
    "id int, text string",
    [
        (1, "Ten years with Java, Spring Boot and Kafka; some SQL; fond of distributed systems."), (2, "We use Golang, C++ and C#; k8s on AWS. go is not enough."), (3, "javascript only"), (4, "RESTful API with GraphQL, gRPC and microservices; CI/CD by GitHub"),
        (5, "6+ years of hands-on harbour engineering experience with ML and LLMs"), (6, "Three years of experience"), (7, "3 to 5 years experience"), (8, None), (9, "éml is no ml"), (10, "retrieval-augmented generation, PyTorch/TensorFlow, NumPy"), (11, "PostgreSQL and postgres, MySQL. MongoDB"), (12, "10-12 years of data experience"),
    ],
)

TITLES = Fixture(
    "id int, title string",
    [(1, "Junior Boat Technician"), (2, "Designer Lamps"), (3, "About us"), (4, "Leading the way"), (5, "Sales"), (6, "PRODUCT manager"), (7, ""), (8, None), (9, "Engineering"), (10, "Team lead, operations")],
)

JOBS = Fixture(
    "id string, scan_id string, page_id string, source_url string, title string, company string, location string, skills array<string>, experience string, employment_type string, description string, extraction_method string, discovered_at timestamp",
    [],
)


def _jobs() -> list[tuple]:
    from datetime import datetime

    rows = [
        ("ML Engineer", ["Python", "PyTorch", "AWS"], "Norwind", "Bergen, NO"), ("Backend Engineer", ["Java", "Spring Boot", "Kafka"], "Norwind", "Remote"), ("Sailor, Second", ["Java", "Kafka"], 'Say "Hi" Inc', "Line\nbreak\r\nhere"),
        ("Analyst", [], None, None), ("Data Engineer", ["SQL", "Kafka", "Python", "Airflow"], "Beta", "Berlin"), ("Go Developer", ["Go", "Distributed Systems"], "Beta", None), ("Writer", [], "Gamma", ""),
    ]
    return [
        (f"job-{i:02d}", "scan-1" if i < 5 else "scan-2", f"page-{i}", f"https://norwind.org/jobs/{i}", t, c, p, s, "Not specified", "FULL_TIME" if i % 2 else None, f"About {t}", "JSON_LD" if i % 2 else "HEURISTIC", datetime(2024, 1, 1 + i // 3, 12))
        for i, (t, s, c, p) in enumerate(rows)
    ]


JOBS.rows = _jobs()

_FILLER = "The crew of this yard keeps forty old boats afloat, writes down each repair, and takes pride in ropes that hold when the weather turns."
POSTING_PAGES = Fixture(
    "id int, url string, html string",
    [
        (1, "https://norwind.org/team/88", '<html><head><title>t</title><script type="application/ld+json">{"@type":"JobPosting","title":"Harbour Systems Analyst","hiringOrganization":{"name":"Norwind"},"jobLocation":{"address":{"addressLocality":"Bergen","addressRegion":"Vestland","addressCountry":"NO"}},"employmentType":["PART_TIME","TEMPORARY"],"description":"&lt;p&gt;Linux, Docker and Redis at sea. 4+ years of practical harbour operations experience&lt;/p&gt;"}</script></head><body><h1>x</h1></body></html>'),
        (2, "https://norwind.org/team/job/rope-designer", f"<html><head><title>Team</title></head><body><main><h1>Rope Designer</h1><p>{_FILLER}</p><p>Python and Docker. 3 years of experience</p></main></body></html>"),
        (3, "https://norwind.org/catalogue/lamp", f"<html><body><main><h1>Lamp Designer Set</h1><p>{_FILLER}</p></main></body></html>"),
        (4, "https://norwind.org/x", '<script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"WebPage"},{"@type":["Thing","jobposting"],"name":"Kafka Lead","hiringOrganization":[{"name":"Beta"}],"applicantLocationRequirements":{"name":"Canada"},"jobLocationType":"TELECOMMUTE","experienceRequirements":{"@type":"X","b":"2 years","a":1}}]}</script>'),
        (5, "https://www.norwind.org/position/9", f'<html><head><meta property="og:title" content=" Data Analyst "><meta property="og:site_name" content="Norwind Ltd"></head><body><div class="the-job-location big">Paris</div><div id="job-description-1">{_FILLER} SQL</div></body></html>'),
        (6, "https://norwind.org/jobs/short", "<h1>Engineer</h1><main>too short</main>"),
        (7, "https://norwind.org/jobs/none", f"<h1>Our history</h1><main>{_FILLER}</main>"),
        (8, "https://norwind.org/other", '<script type="application/ld+json">{"offers":{"@type":"JobPosting","title":"hidden"}}</script>'),
        (9, "https://norwind.org/y", None),
        (10, "https://norwind.org/z", '<script type="application/ld+json">[{"@type":"JobPosting","jobLocation":["Rome",{"address":"Oslo"},{"name":"Bonn"},"Rome"],"hiringOrganization":"Plain"}]</script>'),
        (11, "https://[norwind/jobs/1", f"<h1>Engineer</h1><main>{_FILLER}</main>"),
        (12, "https://norwind.org/team/90", '<script type=" Application/LD+JSON ">{"@type":"JobPosting","title":"Deck Lead"}</script>'),
    ],
)
POSTINGS = Fixture(
    "id int, title string, company string, location string, skills string, experience string, employment_type string, extraction_method string",
    [
        (1, "Harbour Systems Analyst", "Norwind", "Bergen, Vestland, NO", "Docker,Redis,Linux", "4+ years of practical harbour operations experience", "PART_TIME, TEMPORARY", "JSON_LD"),
        (2, "Rope Designer", "norwind.org", "", "Python,Docker", "3 years of experience", "", "HEURISTIC"),
        (4, "Kafka Lead", "Beta", "Canada; Remote", "", "X, 2 years, 1", "", "JSON_LD"),
        (5, "Data Analyst", "Norwind Ltd", "Paris", "SQL", "Not specified", "", "HEURISTIC"),
        (10, "Untitled role", "", "Rome; Oslo; Bonn", "", "Not specified", "", "JSON_LD"),
        (12, "Deck Lead", "", "Not specified", "", "Not specified", "", "JSON_LD"),
    ],
)

_POSTING = '{"@type":"JobPosting","title":"Dock Software Architect","hiringOrganization":{"name":"Norwind"},"jobLocation":{"address":{"addressLocality":"Aarhus","addressCountry":"DK"}},"description":"Go boats, and Java, AWS, Kafka, Terraform ashore"}'
SITE = Fixture(
    "url string, attempt int, status int, content_type string, body string, location string, retry_after string, error string",
    [
        ("http://site.example/", None, 200, "text/html", '<title>Home</title><a href="/a">A</a><a href="/a#again">A</a><a href="/tracked?gclid=77">T</a>', None, None, None),
        ("http://site.example/a", None, 200, "text/html", '<title>A</title><a href="/b?n=7&amp;m=1">B</a><a href="/blocked">X</a><a href="http://elsewhere.example/">E</a>', None, None, None),
        ("http://site.example/b?m=1&n=7", None, 200, "text/html", "<title>B</title>", None, None, None),
        ("http://site.example/tracked", None, 200, "text/html", "<title>Tracked</title>", None, None, None),
        ("http://site.example/blocked", None, 200, "text/html", "<title>Blocked</title>", None, None, None),
        ("http://site.example/flaky", 1, 503, "text/plain", "busy", None, None, None),
        ("http://site.example/flaky", None, 200, "text/html", "<title>Flaky</title>", None, None, None),
        ("http://site.example/moved", None, 302, None, None, "/a", None, None),
        ("http://site.example/away", None, 302, None, None, "http://elsewhere.example/", None, None),
        ("http://site.example/loop", None, 301, None, None, "/loop", None, None),
        ("http://site.example/careers", None, 200, "text/html", '<title>Careers</title><a href="/careers/opening/dock-architect">Dock architect</a><a href="/b?b=2">Other</a>', None, None, None),
        ("http://site.example/careers/opening/dock-architect", None, 200, "text/html", f'<title>Job</title><script type="application/ld+json">{_POSTING}</script>', None, None, None),
    ],
)
SITE_ROBOTS = Fixture("origin string, status int, body string", [("http://site.example", 200, "User-agent: *\nDisallow: /blocked\nCrawl-delay: 0\n")])
SITE_PAGES = Fixture(
    "url string, depth int, title string, outbound_links int",
    [("http://site.example/", 0, "Home", 2), ("http://site.example/a", 1, "A", 2), ("http://site.example/tracked", 1, "Tracked", 0), ("http://site.example/b?m=1&n=7", 2, "B", 0)],
)
SITE_FRONTIER = Fixture(
    "id long, url string, depth int, status string, attempts int, last_error string",
    [
        (1, "http://site.example/", 0, "DONE", 1, None), (2, "http://site.example/a", 1, "DONE", 1, None), (3, "http://site.example/tracked", 1, "DONE", 1, None), (4, "http://site.example/b?m=1&n=7", 2, "DONE", 1, None),
        (5, "http://site.example/blocked", 2, "SKIPPED", 1, "Blocked by robots.txt"),
    ],
)
SITE_POSTINGS = Fixture("source_url string, title string, location string, skills string, extraction_method string", [("http://site.example/careers/opening/dock-architect", "Dock Software Architect", "Aarhus, DK", "Java,AWS,Terraform,Kafka", "JSON_LD")])

HTML_TEXTS = Fixture(
    "id int, html string, title string, h1 string, text string",
    [
        (1, "<html><head><title>A &amp; B</title><style>p{}</style></head><body><h1>One <b>two</b></h1><p>x<br>y</p><script>z</script>tail</body></html>", "A & B", "One two", "One two x y tail"),
        (2, "<p>unclosed<p>next<ul><li>a<li>b</ul>", "", "", "unclosed next a b"),
        (3, "in<i>li</i>ne&nbsp;&lt;tag&gt;", "", "", "inline <tag>"),
        (4, None, "", "", ""),
        (5, "<table><tr><td>1<td>2<tr><td>3</table>", "", "", "1 2 3"),
    ],
)
