"""Features of email, web and file rows. All are row-local built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Internal mail domain (a pattern, so the dot matches any character), domains kept
# whole, the web categories with their codes in order of precedence, and file extensions.
INTERNAL_MAIL = "dtaa.com"
KEEP_SUBDOMAIN = r"google\.com|\.co\.uk|\.co\.nz|live\.com"
CLOUD_SITES = ["dropbox.com", "drive.google.com", "mega.co.nz", "account.live.com"]
LEAK_SITES = ["wikileaks.org", "freedom.press", "theintercept.com"]
SOCIAL_SITES = [
    "facebook.com", "twitter.com", "plus.google.com", "instagr.am", "instagram.com", "flickr.com",
    "linkedin.com", "reddit.com", "about.com", "youtube.com", "pinterest.com", "tumblr.com",
    "quora.com", "vine.co", "match.com", "t.co",
]
JOB_SITES = ["indeed.com", "monster.com", "careerbuilder.com", "simplyhired.com"]
HACK_SITES = [
    "webwatchernow.com", "actionalert.com", "relytec.com", "refog.com", "wellresearchedreviews.com",
    "softactivity.com", "spectorsoft.com", "best-spy-soft.com",
]
WEB_OTHER, WEB_SOCIAL, WEB_CLOUD, WEB_JOB, WEB_LEAK, WEB_HACK = 1, 2, 3, 4, 5, 6
FILE_OTHER = 1
FILE_TYPES = {
    2: ["zip", "rar", "7z"],
    3: ["jpg", "png", "bmp"],
    4: ["doc", "docx", "pdf"],
    5: ["txt", "cfg", "rtf"],
    6: ["exe", "sh"],
}
DISKS = {"C": 1, "R": 2}


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _blank(c: Column) -> Column:
    return c.rlike(r"(?U)^\s*$")


def _occurrences(c: Column, char: str) -> Column:
    """How often an ASCII character occurs; bytes are counted, as they needn't be decoded."""
    return F.octet_length(c) - F.octet_length(F.replace(c, F.lit(char), F.lit("")))


def _words(c: Column) -> Column:
    return _occurrences(c, " ") + 1


def email_features(to: Column, cc: Column, bcc: Column, size: Column, attachments: Column,
                   content: Column) -> dict[str, Column]:
    """Recipient, size and text counts. External recipients may go below zero when one address
    names the internal domain twice."""
    lists = [_text(c) for c in (to, cc, bcc)]
    counts = [F.when(_blank(c), 0).otherwise(_occurrences(c, ";") + 1) for c in lists]
    external = [n - F.regexp_count(c, F.lit(INTERNAL_MAIL)) for n, c in zip(counts, lists)]
    outside = external[0] + external[1] + external[2]
    body = _text(content)
    return {
        "n_des": counts[0] + counts[1] + counts[2],
        "n_atts": F.coalesce(attachments.cast("long"), F.lit(0)),
        "Xemail": (outside > 0).cast("int"),
        "n_exdes": outside,
        "n_bccdes": counts[2],
        "exbccmail": (external[2] > 0).cast("int"),
        "email_size": F.coalesce(size.cast("long"), F.lit(0)),
        "email_text_slen": F.length(body),
        "email_text_nwords": F.when(_blank(body), 0).otherwise(_words(body)),
    }


def url_host(url: Column) -> Column:
    return F.replace(F.regexp_extract(_text(url), "//(.*?)/", 1), F.lit("www."), F.lit(""))


def url_domain(url: Column, host: Column | None = None) -> Column:
    """Host between ``//`` and the next slash without ``www.``; reduced to its last two labels
    unless it is on the keep list."""
    host = url_host(url) if host is None else host
    deep = (_occurrences(host, ".") >= 2) & ~host.rlike(KEEP_SUBDOMAIN)
    tail = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(deep & (tail != ""), tail).otherwise(host)


def url_category(domain: Column, url: Column) -> Column:
    job = reduce(or_, [
        domain.isin(JOB_SITES),
        domain.contains("job") & domain.rlike("hunt|search"),
        domain.contains("aol.com") & _text(url).rlike("recruit|job"),
    ])
    return (
        F.when(domain.isin(CLOUD_SITES), WEB_CLOUD)
        .when(domain.isin(LEAK_SITES), WEB_LEAK)
        .when(domain.isin(SOCIAL_SITES), WEB_SOCIAL)
        .when(job, WEB_JOB)
        .when(domain.isin(HACK_SITES) | domain.contains("keylog"), WEB_HACK)
        .otherwise(WEB_OTHER)
    )


def url_features(url: Column, content: Column, domain: Column | None = None) -> dict[str, Column]:
    """Empty content still counts as one word. ``domain`` is a column that holds ``url_domain``, where there is one."""
    text, body = _text(url), _text(content)
    return {
        "http_type": url_category(url_domain(url) if domain is None else domain, url),
        "url_len": F.length(text),
        "url_depth": F.greatest(F.lit(0), _occurrences(text, "/") - 2),
        "http_c_len": F.length(body),
        "http_c_nwords": _words(body),
    }


def file_extension(filename: Column) -> Column:
    found = F.lower(F.regexp_extract(_text(filename), r"\.([^.]+)$", 1))
    return F.when(found == "", "unknown").otherwise(found)


def file_features(filename: Column, content: Column, extension: Column | None = None) -> dict[str, Column]:
    """``extension`` is a column that holds ``file_extension``, where there is one."""
    name, body = _text(filename), _text(content)
    extension = file_extension(filename) if extension is None else extension
    kind, disk = F.lit(FILE_OTHER), F.lit(0)
    for code, extensions in FILE_TYPES.items():
        kind = F.when(extension.isin(extensions), code).otherwise(kind)
    for letter, code in DISKS.items():
        disk = F.when(name.startswith(letter), code).otherwise(disk)
    return {
        "file_type": kind,
        "file_len": F.length(body),
        "file_nwords": _words(body),
        "disk": disk,
        "file_depth": _occurrences(name, "\\"),
    }
