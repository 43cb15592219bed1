import base64
import hashlib

from lumendex.llm import warc


def test_digest_is_of_the_payload_read(spark, tmp_path):
    """A response stored with another payload of the right length doesn't come back with its header's digest."""
    b = warc.Bundler()
    sha = lambda x: base64.b32encode(hashlib.sha1(x).digest()).decode()
    b.add("1", warc.record("response", "1", "u", b"right", 5, sha(b"right"), None))
    b.add("2", warc.record("response", "2", "u", b"wrong", 5, sha(b"right"), None))
    b.add("3", warc.record("revisit", "3", "u", b"", 5, sha(b"right"), "1"))
    (tmp_path / "part-0").write_bytes(b.finish() + warc._END)
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert got == {1: (5, sha(b"right")), 2: (5, sha(b"wrong")), 3: (5, sha(b"right"))}
