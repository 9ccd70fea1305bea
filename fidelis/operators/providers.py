"""Language models behind one method: complete(prompt, system, temperature, max_tokens) -> text of the reply."""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: Settings of a call unless others are given.
TEMPERATURE, MAX_TOKENS, TIMEOUT = 0.2, 4096, 120.0


class ProviderError(Exception):
    """The provider gave no usable reply."""


class ConfigError(Exception):
    """A setting is missing."""


class NullProvider:
    def complete(self, prompt: str, system: str | None = None, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> str:
        raise ProviderError("no provider is configured")


class Scripted:
    """Deterministic: the reply of the first key that the prompt holds."""

    def __init__(self, replies: dict[str, str], default: str = "{}"):
        self.replies, self.default = replies, default

    def complete(self, prompt: str, system: str | None = None, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> str:
        return next((reply for key, reply in self.replies.items() if key in prompt), self.default)


def post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> bytes:
    with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=timeout) as reply:
        return reply.read()


@dataclass(frozen=True)
class Chat:
    """A server of the public chat-completions protocol. send: how a request is posted (tests put their own)."""

    url: str
    key: str
    model: str
    timeout: float = TIMEOUT
    send: Callable[[str, dict[str, str], bytes, float], bytes] = post

    def complete(self, prompt: str, system: str | None = None, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS) -> str:
        said = [{"role": role, "content": text} for role, text in (("system", system), ("user", prompt)) if text]
        body = json.dumps({"model": self.model, "messages": said, "temperature": temperature, "max_tokens": max_tokens})
        headers = {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}
        try:
            got = json.loads(self.send(f"{self.url.rstrip('/')}/chat/completions", headers, body.encode(), self.timeout))
            return str(got["choices"][0]["message"]["content"])
        except (OSError, ValueError, LookupError, TypeError) as e:  # HTTP errors are OSErrors
            raise ProviderError(f"{type(e).__name__}: {e}"[:300]) from e


def provider_settings(env: dict[str, str] | None = None, prefix: str = "FIDELIS_LLM_") -> dict | None:
    """Key, address, model and timeout from the environment; None without a key."""
    env = os.environ if env is None else env
    if not env.get(f"{prefix}KEY"):
        return None
    if not env.get(f"{prefix}MODEL"):
        raise ConfigError("a key is set, but no model")
    return {"key": env[f"{prefix}KEY"], "url": env.get(f"{prefix}URL", ""), "model": env[f"{prefix}MODEL"], "timeout": float(env.get(f"{prefix}TIMEOUT", TIMEOUT))}


def from_settings(env: dict[str, str] | None = None):
    """The provider that the environment names; one that has no replies where it names none."""
    found = provider_settings(env)
    if found is None:
        return NullProvider()
    if not found["url"]:
        raise ConfigError("a key is set, but no address")
    return Chat(**found)
