"""A pub/sub feed: batches that fail are asked for again, nothing is lost or repeated."""

import socketserver
import threading

import pytest

from tidemark.sources import feed, trades

DAY = "2024-01-02"


class Answer(socketserver.StreamRequestHandler):
    def handle(self):
        what, channel, *at = self.rfile.readline().decode().split()
        messages = self.server.messages[channel]
        if what == "END":
            self.wfile.write(f"{len(messages)}\n".encode())
        else:
            lo, hi = map(int, at)
            self.server.asked.append((channel, lo, hi))
            self.wfile.write("".join(f"{x}\n" for x in messages[lo:hi]).encode())


@pytest.fixture
def server():
    with socketserver.ThreadingTCPServer(("127.0.0.1", 0), Answer) as s:
        s.daemon_threads, s.messages, s.asked = True, {"sz": [], "sh": []}, []
        threading.Thread(target=s.serve_forever, daemon=True).start()
        yield s
        s.shutdown()


def test_replay(spark, server, tmp_path):
    put = lambda channel, lo, hi: server.messages[channel].extend(f"_,_,_,5,1,000001,_,{i + 1},100,70,09:31:00.000" for i in range(lo, hi))
    put("sz", 0, 70)
    options = {"format": feed.NAME, "host": "127.0.0.1", "port": str(server.server_address[1]), "channels": "sz,sh", "perTask": "16"}
    broken, seen = [True], {}

    def keep(batch, epoch):
        rows = [(r["source"], r["seq"], r["price"]) for r in batch.collect()]
        if epoch == 1 and broken.pop() if broken else False:
            raise RuntimeError("lost")
        seen[epoch] = rows

    def run():
        stream = trades.stream_trades(spark, {"SZ": options}, DAY)
        q = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        return q.awaitTermination(120)

    run()
    assert len(server.asked) == 5 and len(seen[0]) == 70
    put("sz", 70, 95)
    put("sh", 0, 20)
    server.asked.clear()
    with pytest.raises(Exception, match="lost"):
        run()
    first = sorted(server.asked)
    put("sz", 95, 99)  # what comes meanwhile isn't part of the batch that is asked for again
    server.asked.clear()
    run()
    assert set(first) <= set(server.asked)
    run()
    got = [r for rows in seen.values() for r in rows]
    assert sorted(got) == sorted([("sz", i, i + 1.0) for i in range(99)] + [("sh", i, i + 1.0) for i in range(20)])
    assert len(seen[1]) == 45


def test_a_feed_that_ends_early_is_an_error():
    reader = feed.FeedReader({"host": "h", "port": "1", "channels": "a"})
    plain, feed.asked = feed.asked, lambda *_: iter(["x"])
    try:
        with pytest.raises(OSError, match="ended"):
            list(reader.read(feed.Range("a", 0, 2)))
        assert [len(b) for b in reader.read(feed.Range("a", 4, 5))] == [1]
    finally:
        feed.asked = plain


def test_ranges():
    reader = feed.FeedReader({"host": "h", "port": "1", "channels": "a,b", "pertask": "10"})
    got = reader.partitions({"a": 5}, {"a": 26, "b": 3})
    assert [(r.channel, r.start, r.end) for r in got] == [("a", 5, 15), ("a", 15, 25), ("a", 25, 26), ("b", 0, 3)]
