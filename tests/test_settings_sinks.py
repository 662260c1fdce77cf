"""Settings, exit codes, and files that are written whole or not at all."""

import json

import pytest

from vellum import settings, sinks


def test_settings_come_from_given_values_then_environment_then_defaults():
    env = {"VELLUM_OCR_CONFIDENCE_THRESHOLD": "55", "VELLUM_OCR_ENGINE": "", "VELLUM_LLM_RETRIES": "0"}
    made = settings.resolve({"ocr_lang": " PT, en,", "llm_retries": 4, "llm_model": None}, env)
    assert (made.ocr_confidence_threshold, made.ocr_engine, made.llm_retries, made.ocr_lang, made.llm_model) == (55, "tesseract", 4, ("pt", "en"), None)
    assert str(made.store) == "out/resolutions.jsonl" and str(made.intermediates) == "out/intermediates"
    for bad in ({"ocr_confidence_threshold": 101}, {"llm_retries": "x"}, {"gross_divergence_threshold": -0.1}, {"nonsense": 1}):
        with pytest.raises(settings.InvalidSetting):
            settings.resolve(bad)
    assert settings.resolve({"ocr_confidence_threshold": 0, "reconcile_confidence_threshold": 1}).ocr_confidence_threshold == 0


def test_only_what_changes_output_counts():
    one, two = settings.resolve({"output_dir": "a", "llm_model": "m"}), settings.resolve({"output_dir": "b", "llm_retries": 9, "llm_model": "n"})
    assert one.affecting("extract") == two.affecting("extract") and "gross_divergence_threshold" not in one.affecting("extract")
    assert one.affecting("extract", chooser_reachable=True) != two.affecting("extract", chooser_reachable=True)
    assert one.affecting("validate")["llm_decode"] == {"temperature": 0, "seed": None}
    with pytest.raises(settings.InvalidSetting):
        one.affecting("publish")
    assert one.with_reliability({"b": 1.0, "a": 2.0}).native_reliability == (("a", 2.0), ("b", 1.0))


def test_exit_codes():
    kinds = (settings.InvalidSetting, settings.UnreadableSource, settings.ChooserUnavailable, settings.NameTaken, settings.ReviewNeeded, settings.Exhausted, settings.OcrUnavailable)
    assert [settings.exit_code(k("x")) for k in kinds] == [2, 3, 4, 5, 6, 7, 8]
    assert settings.exit_code(None) == 0 and settings.exit_code(KeyError("x")) == 1 and settings.ReviewNeeded(state="unresolved").state == "unresolved"


@pytest.mark.parametrize("host, local", [("localhost", True), ("LOCALHOST.", True), ("127.8.0.1", True), ("::1", True), ("10.0.0.1", False), ("localhost.example.org", False), ("0.0.0.0", False), (None, False), ("", False)])
def test_loopback(host, local):
    assert settings.is_local(host) is local


def test_logs_survive_a_torn_last_line(spark, tmp_path):
    log = tmp_path / "a" / "log.jsonl"
    assert sinks.log_records(log) == []
    sinks.append(log, [{"b": 1, "a": "é"}])
    sinks.append(log, [{"c": "  R$ 1.599,80  \tspaced and\nnewlined  "}])
    assert log.read_text().split("\n")[0] == '{"a": "é", "b": 1}' and sinks.log_records(log)[1]["c"].endswith("newlined  ")
    with log.open("a") as f:
        f.write('{"torn": ')
    assert len(sinks.log_records(log)) == 2
    got = sinks.scan_logs(spark, str(log)).orderBy("line_no").collect()
    assert [r.status for r in got] == ["record", "record", "torn"]
    sinks.append(log, [{"d": 1}])
    assert [list(r) for r in sinks.log_records(log)] == [["a", "b"], ["c"], ["d"]]
    log.write_text('{"a": 1}\nbad\n{"b": 1}\n')
    with pytest.raises(json.JSONDecodeError):
        sinks.log_records(log)


def test_names_are_never_overwritten(tmp_path):
    stem = tmp_path / "doc.candidate.ocr"
    made = sinks.write_record(stem, {"x": "ü"}, "# a\r\nb\rc")
    assert [p.name for p in made] == ["doc.candidate.ocr.json", "doc.candidate.ocr.md"] and made[1].read_bytes() == b"# a\nb\nc"
    assert sinks.write_record(stem, {"x": "ü"}) == made[:1]
    with pytest.raises(settings.NameTaken):
        sinks.write_record(stem, {"x": "y"})
    staged = sinks.put(tmp_path / "s.md", b"text")
    assert sinks.publish(staged, tmp_path / "final.md").read_bytes() == b"text" and not staged.exists()
    with pytest.raises(settings.NameTaken):
        sinks.publish(sinks.put(tmp_path / "s.md", b"other"), tmp_path / "final.md")
    assert (tmp_path / "final.md").read_bytes() == b"text"


def test_source_files_and_artifacts(spark, tmp_path):
    import hashlib

    from vellum.sources import files

    contents = {"a.pdf": b"%PDF-1.7\n...trailer << /Root 1 >>", "b.pdf": b"%PDF-1.4 x" + b"y" * 9000 + b"trailer << /Encrypt 5 0 R >>", "c.pdf": b"hello"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: (r.status, r.source_sha256, r.n_bytes) for r in files.documents(spark, str(tmp_path)).collect()}
    assert {n: x[0] for n, x in got.items()} == {"a.pdf": "ok", "b.pdf": "encrypted", "c.pdf": "not_pdf"}
    assert all(got[n][1:] == (hashlib.sha256(d).hexdigest(), len(d)) for n, d in contents.items())
    pinned = {n: hashlib.sha256(d).hexdigest() for n, d in contents.items()}
    files.verify_artifacts(spark, str(tmp_path), pinned)
    faulty = {**pinned, "c.pdf": "0" * 64, "e.bin": "0" * 64}
    assert [tuple(r) for r in files.artifact_faults(spark, str(tmp_path), faulty).orderBy("name").collect()] == [("c.pdf", "differs"), ("e.bin", "missing")]
    with pytest.raises(ValueError, match="c.pdf"):
        files.verify_artifacts(spark, str(tmp_path), faulty)


def test_candidates_are_written_by_family(spark, tmp_path):
    from vellum.sources import files

    rows = spark.createDataFrame([("ocr:tesseract", "x"), ("docling", "é"), ("ocr:rapidocr", "y")], "technique string, text string")
    files.write_candidates(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert sorted((r.family, r.text) for r in back.collect()) == [("docling", "é"), ("ocr", "x"), ("ocr", "y")]
