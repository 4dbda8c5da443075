import json
import urllib.request

from millrace.operators.learners import NaiveBayesClassifier
from millrace.plans import serving
from millrace.sources import generators


def test_server_and_checkpoints(spark, tmp_path):
    x = generators.Blobs(80, 2, 2, 0.5, [[0, 0], [6, 6]], random_state=1).generate(spark)
    m = NaiveBayesClassifier().fit(x, "y", ["f0", "f1"])
    key = serving.serve(m, port=0)
    try:
        ask = urllib.request.Request(f"http://{key}/models/default/predict", json.dumps({"rows": [{"f0": 0.1, "f1": 0.2}, {"f0": 6.0, "f1": 5.5}]}).encode(), method="POST")
        assert json.load(urllib.request.urlopen(ask))["predictions"] == [0, 1]
        assert json.load(urllib.request.urlopen(f"http://{key}/health"))["status"] == "ok"
        assert serving.server_status()[key]["models"] == ["default"]
    finally:
        serving.stop_server()
    c = serving.ModelCheckpoint(str(tmp_path), max_to_keep=2)
    paths = [c.update(m, {"score": s}) for s in (0.3, 0.9, 0.5)]
    assert c.best == paths[1] and len(c.kept) == 2 and not (tmp_path / "checkpoint-000000").exists()
    assert serving.ModelSerializer().load(c.best).predict(x).where("prediction = y").count() == 80
    manager = serving.ModelManager(1)
    manager.add("a", m)
    manager.add("b", m)
    assert manager.names() == ["b"]
