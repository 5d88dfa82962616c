"""Model clients: what answers the pipeline's messages."""

from __future__ import annotations

import ipaddress
import json
import os
import socket
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Mapping
from typing import Any, Protocol
from urllib.parse import urlsplit

from skillweave.plans.config import Section, model_url

Messages = list[dict[str, str]]


class ModelClient(Protocol):
    """Anything that answers; it is pickled to the executors. The answer is the raw text."""

    def complete(self, stage: str, data_id: str, messages: Messages, as_json: bool) -> str: ...


def check_endpoint(url: str, allow_public: bool = False) -> None:
    """http or https with a host and without credentials; unless allowed, all of the host's addresses must be
    private, loopback or link-local."""
    parts = urlsplit(url)
    if parts.scheme not in ("http", "https"):
        raise ValueError("the model URL must use http or https")
    if not parts.hostname:
        raise ValueError("the model URL has no host")
    if parts.username or parts.password:
        raise ValueError("the model URL must not hold credentials")
    if allow_public:
        return
    try:
        found = socket.getaddrinfo(parts.hostname, parts.port or {"http": 80, "https": 443}[parts.scheme])
    except socket.gaierror as e:
        raise ValueError(f"the model host {parts.hostname!r} has no address") from e
    for address in {ipaddress.ip_address(x[4][0].partition("%")[0]) for x in found}:
        if not (address.is_private or address.is_loopback or address.is_link_local):
            raise ValueError(f"the model host {parts.hostname!r} is public ({address}); it must be allowed explicitly")


class HttpClient:
    """Chat completions over HTTP, with retries."""

    def __init__(self, settings: Section) -> None:
        base = model_url(settings).rstrip("/")
        check_endpoint(base, settings.allow_public_url)
        self.settings = settings
        self.endpoint = base if base.endswith("/chat/completions") else f"{base}/chat/completions"

    def complete(self, stage: str, data_id: str, messages: Messages, as_json: bool) -> str:
        s = self.settings
        body: dict[str, Any] = {"model": s.model, "messages": messages, "temperature": s.temperature}
        body["max_tokens"] = s.max_json_tokens if as_json else s.max_code_tokens
        if as_json:
            body["response_format"] = {"type": "json_object"}
        headers = {"Content-Type": "application/json"}
        # read where it is used, on an executor; only the variable's name travels
        if key := os.environ.get(s.api_key_env, ""):
            headers["Authorization"] = f"Bearer {key}"
        call = urllib.request.Request(self.endpoint, json.dumps(body).encode(), headers, method="POST")
        for attempt in range(s.max_retries + 1):
            try:
                with urllib.request.urlopen(call, timeout=s.timeout_seconds) as answer:
                    return str(json.load(answer)["choices"][0]["message"]["content"])
            except (urllib.error.URLError, TimeoutError, LookupError, TypeError, ValueError) as e:
                problem = e
            if attempt < s.max_retries:
                time.sleep(min(4.0, 0.5 * 2**attempt))
        raise RuntimeError(f"the model did not answer: {problem}")


class ScriptedClient:
    """Fixed answers by stage: a value, or a function of (stage, data_id, messages). Objects are sent as JSON."""

    def __init__(self, answers: Mapping[str, Any | Callable[[str, str, Messages], Any]]) -> None:
        self.answers = dict(answers)

    def complete(self, stage: str, data_id: str, messages: Messages, as_json: bool) -> str:
        if stage not in self.answers:
            raise KeyError(f"no answer for {stage}")
        answer = self.answers[stage]
        value = answer(stage, data_id, messages) if callable(answer) else answer
        if as_json and not isinstance(value, (dict, str)):
            raise TypeError(f"the answer for {stage} must be an object")
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
