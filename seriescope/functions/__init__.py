"""Text forms of estimates."""
