import hashlib
import subprocess

from patchsieve.llm.warc import archived, read_archives, resolved, write_archives

SCHEMA = "page_id long, url string, html string, type string, size long, digest string"
LONG = "é<p>" * 400 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"
ROWS = [
    (1, "http://a\r\nX: y", LONG), (5, None, LONG), (3, "u", LONG), (None, "n", LONG), (5, None, LONG), (7, "s", "ab"), (8, "s", "ab"),
    (9, "e", None), (10, "e", ""), (11, "q", "\r\n\r\n"), (12, "q", "\r\n" * 600), (13, "big", "x" * 2_000_000), (None, "z", "z" * 1_000), (None, "z", "z" * 1_000)]


def pages(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "t", 1, "d") for r in rows], SCHEMA)


def test_round_trip_and_revisits(spark):
    path, key = write_archives(pages(spark), compression="none")
    records = read_archives(spark, path, key)
    bodies = {(r.page_id, bytes(r.payload).decode()) for r in records.where("type = 'response'").collect()}
    assert bodies == {(i, h or "") for i, _, h in ROWS if h != LONG or i == 5}
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in resolved(records).collect())
    want = []
    for i, _, h in ROWS:
        body = (h or "").encode()
        again = h == LONG and i != 5
        want.append((str(i), "revisit" if again else "response", 5 if again else None, len(body), hashlib.sha1(body).hexdigest()))
    assert got == sorted(want)
    assert resolved(records).where("NOT intact").count() == 0


def test_files_are_plain_archives(spark):
    """Read by the declared lengths alone, as any reader would."""
    path, key = write_archives(pages(spark), compression="none")
    names = subprocess.run(["find", path.removeprefix("file:"), "-name", "part-*"], capture_output=True, text=True, check=True).stdout.split()
    kinds = []
    for name in names:
        with open(name, "rb") as f:
            data = f.read()
        while data:
            assert data.startswith(b"WARC/1.1\r\n")
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            kinds.append(fields["WARC-Type"])
            data = rest[size + 4:]
    assert kinds.count("revisit") == 3 and kinds.count("response") == len(ROWS) - 3 and kinds.count("warcinfo") == 1


def test_no_rows(spark):
    assert archived(pages(spark, [])).count() == 0
