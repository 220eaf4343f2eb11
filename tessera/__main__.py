"""Answer questions from the command line.

python -m tessera PASSAGES QUESTIONS MODEL.json [LIMIT]: parquet tables of
passages and questions, and a model's numbers; prints one JSON line a question.

python -m tessera serve PASSAGES MODEL.json [PORT]: answers over HTTP.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from . import server, session
from .operators import contracts, governance, service
from .operators.sufficiency import Model


def read_model(path: str) -> Model:
    """A published baseline, or a model's bare numbers."""
    numbers = json.loads(Path(path).read_text())
    if "training" in numbers:
        return contracts.model_of(numbers)
    return Model(*(tuple(numbers[k]) if isinstance(numbers[k], list) else numbers[k] for k in ("coefficients", "intercept", "means", "scales", "threshold")))


def serve(args: list[str]) -> int:
    passages = session.build("answers").read.parquet(args[0]).cache()
    with server.server(server.asker(passages, read_model(args[1])), port=int(args[2]) if len(args) == 3 else 8000) as running:
        print("http://%s:%d/" % running.server_address[:2])
        try:
            running.serve_forever()
        except KeyboardInterrupt:
            pass
    return 0


def main(args: list[str]) -> int:
    if args[:1] == ["serve"] and len(args) in (3, 4):
        return serve(args[1:])
    if len(args) not in (3, 4):
        print(__doc__, file=sys.stderr)
        return 2
    spark = session.build("answers")
    model = read_model(args[2])
    questions = spark.read.parquet(args[1])
    governance.enforce(service.question_violations(questions), "questions")
    for line in service.answer(spark.read.parquet(args[0]), questions, model, int(args[3]) if len(args) == 4 else 5).toJSON().toLocalIterator():
        print(line)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
