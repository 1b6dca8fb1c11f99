"""Reports of an analysis as text, JSON, Markdown, Mermaid and DOT."""
