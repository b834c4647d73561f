"""Profiles and settings of the engine."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Profile:
    name: str
    patterns: tuple[str, ...]
    legs: tuple[str, ...]
    rerank_least: float
    embeddings: bool = True


#: What each kind of collection holds and how it is searched.
PROFILES = {
    p.name: p
    for p in (
        Profile("iac", ("*.tf", "*.tfvars", "*.hcl", "*.yaml", "*.yml", "*.sh", "*.bash"), ("structural", "lexical"), 0.15, False),
        Profile("dotnet", ("*.cs",), ("embeddings", "lexical", "structural"), 0.10),
        Profile("python", ("*.py",), ("embeddings", "lexical", "structural"), 0.47),
        Profile("shell", ("*.sh", "*.bash"), ("structural", "lexical"), 0.15, False),
        Profile("code", ("*.js", "*.ts", "*.tsx", "*.jsx", "*.go", "*.rs", "*.java", "*.cpp", "*.c", "*.h", "*.hpp", "*.rb", "*.toml"), ("embeddings", "lexical", "structural"), 0.47),
    )
}


@dataclass
class Settings:
    profile: str = "code"
    top_k: int = 10
    mode: str = "hybrid"
    rerank: bool = False
    least_cosine: float = 0.82
    exclude: list[str] = field(default_factory=lambda: ["**/node_modules/**", "**/.git/**", "**/__pycache__/**", "**/migrations/**"])
    source_roots: list[str] = field(default_factory=list)  # folders below the tree's root; all of it without any
    max_file_kb: int = 0
    tool_tokens: int = 8000
    session_window: int = 120_000
    session_share: float = 0.30
    compression: str = "minimal"
    #: The lexical leg: grep, or bm25.
    lexical: str = "grep"
    #: Absolute paths outside it are foreign to a project.
    root: str | None = None

    @property
    def session_cap(self) -> int:
        return int(self.session_window * self.session_share)

    @property
    def spec(self) -> Profile:
        return PROFILES[self.profile]
