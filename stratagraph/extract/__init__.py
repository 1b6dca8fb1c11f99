"""Facts from source text: small lexers for Go, Rust, TypeScript and Java."""
