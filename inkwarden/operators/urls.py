"""URLs in text: extraction, hosts, and what makes one suspicious."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkwarden.functions import text as T
from inkwarden.plans import phrases as P


def urls(text: Column) -> Column:
    """Distinct URLs in order of first use, without '.', ',' and ')' at the end."""
    found = F.regexp_extract_all(text, F.lit(P.FLAGS + P.URL), F.lit(0))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,)]+$", "")))


def issues(url: Column) -> Column:
    """array<string> of reasons for suspicion, in a fixed order; empty for none."""
    host = T.host_suffix(url)
    tld = F.when(host.endswith(P.SUSPICIOUS_TLDS[0]), P.SUSPICIOUS_TLDS[0])
    for t in P.SUSPICIOUS_TLDS[1:]:
        tld = tld.when(host.endswith(t), t)
    return F.array_compact(F.array(
        F.when(url.rlike("^" + P.FLAGS + P.IP_URL), F.lit("direct IP address — no domain")),
        F.when(host.isin(*P.SHORTENERS), F.concat(F.lit("URL shortener ("), host, F.lit(")"))),
        F.when(tld.isNotNull(), F.concat(F.lit("suspicious TLD ("), tld, F.lit(")"))),
        F.when(url.rlike(P.FLAGS + P.CREDENTIAL_PARAM), F.lit("credential/token query param")),
        F.when(F.char_length(T.query_of(url)) > P.LONG_QUERY, F.lit("unusually long query string (possible data exfiltration)")),
    ))


def severity(reasons: Column) -> Column:
    joined = F.array_join(reasons, " ")
    return F.when(joined.contains("IP") | joined.contains("credential") | joined.contains("exfil"), "high").otherwise("medium")
