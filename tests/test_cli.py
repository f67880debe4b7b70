"""The command line from seeds to reports."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from corpusloom.__main__ import main


def lines(path):
    return [json.loads(x) for p in sorted(path.rglob("part-*")) if p.suffix == ".json" for x in p.read_text().splitlines()]


def test_from_seeds_to_reports(spark, tmp_path):
    seeds = [{"intent": "price", "q": f"问题 {i} 多少钱?", "a": f"{i} 元一杯。", "keywords": [str(i)], "ood": False} for i in range(10, 20)]
    seeds += [{"intent": "ood", "q": f"别的事 {i}?", "a": "抱歉,我无法回答。", "keywords": ["抱歉"], "ood": True} for i in range(5)]
    (tmp_path / "seeds.jsonl").write_text("\n\n".join(json.dumps(s, ensure_ascii=False) for s in seeds))
    (tmp_path / "extra.jsonl").write_text(json.dumps({**seeds[0], "q": "新的问题?", "source": "evolved"}) + "\n" + json.dumps(seeds[1]) + "\n")
    at = lambda x: str(tmp_path / x)
    main(["build", "--seeds", at("seeds.jsonl"), "--extra-file", at("extra.jsonl"), "--out", at("corpus"), "--stats", at("stats.json")], spark)
    stats = json.loads((tmp_path / "stats.json").read_text())
    assert stats["raw_count"] == (15 + 64 + 96 + 20 + 5 + 16) * 5 + 2 and stats["dedup_dropped"] == 1
    assert stats["source"]["extra"] == 2 and len(lines(tmp_path / "corpus")) == stats["final_count"]
    (tmp_path / "resp.jsonl").write_text("\n".join(json.dumps({"model": m, "q": s["q"], "resp": s["a"] if m == "good" else "不知道"}) for m in ("good", "bad") for s in seeds))
    main(["evaluate", "--data-file", at("seeds.jsonl"), "--responses", at("resp.jsonl"), "--report", at("r.md")], spark)
    assert "Best: good (100.0%)" in (tmp_path / "r.md").read_text()
    main(["rft", "--data-file", at("seeds.jsonl"), "--responses", at("resp.jsonl"), "--out", at("rft")], spark)
    assert len(lines(tmp_path / "rft")) == 15
    main(["pairs", "--data-file", at("seeds.jsonl"), "--responses", at("resp.jsonl"), "--out", at("pairs")], spark)
    assert {p["rejected"] for p in lines(tmp_path / "pairs")} == {"不知道"}
    main(["prompts", "--data-file", at("seeds.jsonl"), "--ood-ratio", "0.5", "--out", at("prompts")], spark)
    assert len(lines(tmp_path / "prompts")) == 10
    main(["questions", "--num-questions", "7", "--out", at("math")], spark)
    assert len(lines(tmp_path / "math")) == 7
    main(["build", "--out", at("own"), "--stats", at("own.json"), "--dedup", "q"], spark)
    assert json.loads((tmp_path / "own.json").read_text())["final_count"] == 1250


def test_encode_and_generated(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    at = lambda x: str(tmp_path / x)
    texts = [f"story {k} of a fox" for k in range(30)]
    spark.createDataFrame(list(enumerate(texts)), "id long, text string").write.parquet(at("texts"))
    spec = public_tokenizers.path("byte_bpe_50k.json")
    main(["encode", "--data-file", at("texts"), "--key", "id", "--tokenizer", spec, "--out", at("enc"), "--block", "16"], spark)
    want = [x for t in texts for x in [*Tokenizer.from_file(spec).encode(t).ids, 0]]
    raw = b"".join(f.read_bytes() for f in sorted((tmp_path / "enc" / "tokens").glob("part-*.bin")))
    assert [int.from_bytes(raw[k : k + 2], "little") for k in range(0, len(raw), 2)] == want
    assert json.loads((tmp_path / "enc" / "meta.json").read_text())["total_tokens"] == len(want)
    (tmp_path / "gen.jsonl").write_text("\n".join(json.dumps({"key": k, "text": t}) for k, t in enumerate(["a b", "a b"])))
    main(["generated", "--data-file", at("gen.jsonl"), "--report", at("gen.md")], spark)
    assert "distinct-1: 0.5000" in (tmp_path / "gen.md").read_text()


def test_a_service_is_asked_once(spark, tmp_path, monkeypatch):
    asked = []

    class Chat(BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][0]["content"]
            asked.append(prompt)
            items = json.dumps([{"question": f"新的说法 {len(asked)}?", "answer": "15 元一杯。"}], ensure_ascii=False)
            body = json.dumps({"choices": [{"message": {"content": items}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Chat)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("CHAT_URL", f"http://127.0.0.1:{server.server_port}/")
    at = lambda x: str(tmp_path / x)
    seeds = [{"intent": "price", "q": f"问题 {i} 多少钱?", "a": f"{i} 元一杯。", "keywords": [str(i)], "ood": False} for i in range(12)]
    (tmp_path / "seeds.jsonl").write_text("\n".join(json.dumps(s, ensure_ascii=False) for s in seeds))
    for k in range(2):
        main(["evolve", "--seeds", at("seeds.jsonl"), "--sample", "12", "--model", "m", "--journal", at("journal"), "--out", at(f"evolved{k}")], spark)
        main(["infer", "--model", "m", "--journal", at("journal"), "--out", at(f"inferred{k}")], spark)
    server.shutdown()
    assert len(asked) == len(set(asked)) == 12 + 5
    assert sorted(map(str, lines(tmp_path / "evolved0"))) == sorted(map(str, lines(tmp_path / "evolved1"))) and len(lines(tmp_path / "evolved0")) == 12
    assert {r["completion"] for r in lines(tmp_path / "inferred0")} == {r["completion"] for r in lines(tmp_path / "inferred1")}
