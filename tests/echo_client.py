"""Deterministic offline model client for tests (no network)."""

from panelscore.config import METRICS


class EchoPanelClient:
    """Deterministic offline client (tests, demos): no network.

    answer/answer_logger: ``<MODEL>: <prompt>``; judge: a JSON object whose
    eight scores derive from the request length ``L`` (metric k ->
    ((L + 13k) mod 101) / 100); reasoning: ``because <model>``; realtime:
    'True' when the prompt length is even; ats: a score from the length.
    ``fail_models`` always raise, to exercise the error policies.
    """

    def __init__(self, fail_models=(), log_path: str | None = None):
        self.fail_models = set(fail_models)
        self.log_path = log_path

    def complete(self, model: str, prompt: str, spec) -> str:
        if self.log_path:
            import hashlib

            with open(self.log_path, "a", encoding="utf-8") as f:
                f.write(f"{spec.role}\t{model}\t{hashlib.sha1((prompt or '').encode()).hexdigest()}\n")
        if model in self.fail_models:
            raise RuntimeError("service unavailable")
        text = prompt or ""
        n = len(text)
        if spec.role in ("answer", "answer_logger"):
            return f"{model.upper()}: {text}"
        if spec.role == "judge":
            scores = ", ".join(f'"{m}": {((n + 13 * k) % 101) / 100}' for k, m in enumerate(METRICS))
            return f'Evaluation: {{{scores}, "reasoning": "len {n}", "notes": ""}}'
        if spec.role == "reasoning":
            return f"because {model}"
        if spec.role == "realtime":
            return "True" if n % 2 == 0 else "False"
        return f'{{"ats_score": {n % 101}, "strengths": [], "gaps": [], "suggestions": []}}'


def echo_client_factory(fail_models=(), log_path: str | None = None):
    def make():
        return EchoPanelClient(fail_models, log_path)

    return make
