"""Results of human leads, case by case."""

from __future__ import annotations

import pytest

from tidemark.operators import leads as ld

ARCHIVE = "https://archive.example/data/"


def acc(k: int) -> str:
    return f"{k:010d}-24-{k:06d}"


def url(k: int) -> str:
    return f"{ARCHIVE}{k % 7}/{acc(k)}.txt"


FILINGS = [(1, "10", "AA", 5), (2, "10", "AA", 9), (3, "10", "BB", 20), (4, "20", "CC", 1), (5, "20", "CC", 1), (6, "30", None, 3), (7, "40", "DD", 2), (8, "50", "EE", 2)]
# what each document says: relevant, material; 7's could not be read
READ = [(1, True, True), (2, True, True), (3, True, False), (4, True, True), (5, False, False), (6, True, True), (7, None, None), (8, True, True), (99, True, True)]
FACTS = [("10", 2), ("10", 2), ("10", 1), ("20", 4)]
ATTEMPTS = [(1, "a", 1, False, 3), (1, "b", 2, True, 2), (2, "c", 1, True, 0), (8, "d", 1, False, 0), (8, "d", 3, False, 0), (8, "e", 2, True, 1), (3, "x", 1, True, 1)]
MAPPING = [("ZZ", "30"), ("ZZ", "40"), ("DD", "10"), ("YY", "77")]
# lead: cik, ticker, urls, then source, accession, tier outcome, analyst, verification, xbrl, facts, same filing, disposition, basis
CASES = {
    1: ("10", "AA", [], "resolved", 2, "escalate", "assessed", "assessed", "assessed", 3, 2, "supported", "brief"),
    2: (None, "AA", ["http://x/y", url(1), url(4)], "resolved", 1, "escalate", "assessed", "not_assessed", "assessed", 3, 1, "supported", "brief"),
    3: ("10", None, [], "resolved", 3, "retain", "not_assessed", "not_assessed", "assessed", 3, 0, "inconclusive", "classified"),
    4: ("99", "CC", [], "resolved", 5, "skip", "not_assessed", "not_assessed", "assessed", 1, 0, "inconclusive", "classified"),
    5: (None, "ZZ", None, "resolved", 6, "escalate", "failed", "not_assessed", "failed", 0, 0, "inconclusive", "not_validated"),
    6: (None, "DD", [], "retrieval_failed", None, None, "not_assessed", "not_assessed", "not_assessed", None, None, "insufficient_evidence", "unreadable"),
    7: (None, None, [ARCHIVE + "index.html"], "unresolved", None, None, "not_assessed", "not_assessed", "not_assessed", None, None, "insufficient_evidence", "no_filing"),
    8: ("50", "EE", [url(99)], "resolved", 8, "escalate", "assessed", "not_assessed", "failed", 0, 0, "inconclusive", "no_brief"),
    9: ("99", None, [url(98)], "unresolved", None, None, "not_assessed", "not_assessed", "not_assessed", None, None, "insufficient_evidence", "no_filing"),
    10: ("10", "AA", [url(98)], "retrieval_failed", None, None, "not_assessed", "not_assessed", "not_assessed", None, None, "insufficient_evidence", "unreadable"),
    11: ("99", "YY", [], "unresolved", None, None, "not_assessed", "not_assessed", "not_assessed", None, None, "insufficient_evidence", "no_filing"),
    12: ("30", "ZZ", [], "unresolved", None, None, "not_assessed", "not_assessed", "not_assessed", None, None, "insufficient_evidence", "no_filing"),
}


@pytest.fixture(scope="module")
def results(spark):
    def frame(rows, schema):
        return spark.createDataFrame(rows, schema)

    leads = frame([(k, *c[:3]) for k, c in CASES.items()], "lead_id long, cik string, ticker string, urls array<string>")
    filings = frame([(acc(k), c, t, url(k), at) for k, c, t, at in FILINGS], "accession string, cik string, ticker string, url string, filed_at long")
    read = frame([(url(k), r, m) for k, r, m in READ], "url string, relevant boolean, material boolean")
    facts = frame([(c, acc(k)) for c, k in FACTS], "cik string, accession string")
    attempts = frame(ATTEMPTS, "lead_id long, attempt_id string, at long, brief boolean, numeric_claims long")
    return ld.lead_results(leads, filings, read, facts, attempts, frame(MAPPING, "ticker string, cik string"), ARCHIVE).cache()


def test_lead_results(results):
    got = {r.lead_id: r for r in results.collect()}
    assert set(got) == set(CASES) and results.count() == len(CASES)
    for k, (_, _, _, source, filing, outcome, analyst, verified, xbrl, n, same, disposition, basis) in CASES.items():
        r = got[k]
        assert (k, r.source_status, r.accession, r.tier_outcome, r.analyst_status) == (k, source, acc(filing) if filing else None, outcome, analyst)
        assert (k, r.verification_status, r.xbrl_status, r.n_facts, r.n_same_filing) == (k, verified, xbrl, n, same)
        assert (k, r.disposition, r.basis) == (k, disposition, basis)
        assert r.tier == {"escalate": 2, "retain": 0, "skip": 0, None: None}[outcome]


def test_lineage_of_results(results):
    assert [(r.lead_id, r.violation) for r in ld.lineage_violations(results).collect()] == [(8, "attempt_repeated")]
