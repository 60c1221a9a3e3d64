"""A document model behind a local chat service: one request a question, errors told apart by what they mean for a scan."""

from __future__ import annotations

import json
import logging
from dataclasses import dataclass
from urllib import error, request

from ..functions import fixed
from ..operators.model import ModelFailure, ModelTimeout, ModelUnreachable, reply_schema

LOG = logging.getLogger(__name__)
#: Output tokens of a classification, an extraction and a recovery.
TOKENS = {"classify": 500, "extract": 750, "recover": 350}


@dataclass(frozen=True)
class ChatModel:
    """Asks ``url``/api/chat without streaming and at temperature 0; the reply's text is returned as it is."""

    url: str
    model: str
    timeout_seconds: int = 600

    def classify(self, prompt: str) -> str:
        return self._ask(prompt, reply_schema(fixed.GENERAL), TOKENS["classify"])

    def extract(self, prompt: str) -> str:
        fields = prompt.partition("\nFields: ")[2].partition("\n")[0].split(", ")
        return self._ask(prompt, reply_schema(fields), TOKENS["extract"])

    def _ask(self, prompt: str, schema: dict, tokens: int) -> str:
        body = {"model": self.model, "messages": [{"role": "user", "content": prompt}], "stream": False, "think": False, "format": schema, "options": {"temperature": 0, "num_predict": tokens}}
        call = request.Request(f"{self.url}/api/chat", json.dumps(body).encode(), {"Content-Type": "application/json"})
        try:
            with request.urlopen(call, timeout=self.timeout_seconds) as response:
                answer = json.loads(response.read().decode("utf-8"))
        except TimeoutError as exc:
            raise ModelTimeout(f"no answer in {self.timeout_seconds} seconds") from exc
        except error.HTTPError as exc:
            raise ModelFailure(f"status {exc.code}: {exc.read().decode('utf-8', 'replace')[:500]}") from exc
        except OSError as exc:  # refused, reset, no route, not permitted
            if isinstance(getattr(exc, "reason", None), TimeoutError):
                raise ModelTimeout(f"no answer in {self.timeout_seconds} seconds") from exc
            raise ModelUnreachable(f"{self.url}: {exc}") from exc
        except ValueError as exc:
            raise ModelFailure("the service's answer is no JSON") from exc
        seconds = lambda name: round(answer.get(name, 0) / 1e9, 2)
        LOG.info("model=%s total=%s load=%s prompt_tokens=%s output_tokens=%s", self.model, seconds("total_duration"), seconds("load_duration"), answer.get("prompt_eval_count"), answer.get("eval_count"))
        content = (answer.get("message") or {}).get("content") or ""
        if answer.get("done_reason") == "length" or not content.strip():
            raise ModelFailure(f"the answer was cut off or empty: {answer.get('done_reason')}")
        return content
