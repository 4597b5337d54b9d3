"""Operators for preparing language-model training corpora; nothing else imports this package."""
