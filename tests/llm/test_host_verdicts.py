"""The verdicts of hosts act on their documents."""

import math

from lorestone.llm import hostrules

DOCS = "doc_id long, source string, text string"
PLAIN = " ".join(f"word{i}" for i in range(80))
SIGNS = PLAIN + " " + "# $ % & | " * 12


def corpus(spark, hosts):
    """``hosts`` maps a host to its (documents, failing ones)."""
    rows, at = [], 0
    for host, (n, failing) in hosts.items():
        for i in range(n):
            rows.append((at, host, SIGNS if i < failing else PLAIN))
            at += 1
    return spark.createDataFrame(rows, DOCS)


def expected(hosts):
    """Hosts that are no better than the corpus in symbols."""
    n, failed = [h[0] for h in hosts.values()], [h[1] for h in hosts.values()]
    m, size = sum(failed) / sum(n), sum(n) / len(n)
    shares = [f / k for f, k in zip(failed, n, strict=True)]
    spread = sum(s * s for s in shares) / len(n) - (sum(shares) / len(n)) ** 2 - m * (1 - m) * sum(1 / k for k in n) / len(n)
    strength = max(1.0, min(m * (1 - m) / spread - 1 if spread > 0 else size, size))
    bad = set()
    for host, (k, f) in hosts.items():
        rate = (f + m * strength) / (k + strength)
        if rate + 1.645 * math.sqrt(rate * (1 - rate) / (k + strength + 1)) >= m:
            bad.add(host)
    return bad


def test_failing_documents_stay_only_with_a_better_host(spark):
    hosts = {"junk": (200, 90), "mixed": (200, 30), "clean": (400, 2), None: (60, 4), "small": (3, 1)}
    bad = expected(hosts)
    assert "clean" not in bad and "junk" in bad
    kept = {}
    for r in hostrules.judge(corpus(spark, hosts)).collect():
        failing = r.judged.n_symbols > 0
        kept.setdefault((r.source, failing), set()).add(r.judged.kept)
    assert all(kept[host, False] == {True} for host in hosts)
    assert {host: kept[host, True] for host in hosts} == {host: {host not in bad} for host in hosts}


def test_alike_hosts_are_no_better_than_the_corpus(spark):
    hosts = {f"h{i}": (100, 8 + i % 3) for i in range(6)}
    assert expected(hosts) == set(hosts)
    judged = hostrules.judge(corpus(spark, hosts)).select("judged.n_symbols", "judged.kept").collect()
    assert all(r.kept == (r.n_symbols == 0) for r in judged)
