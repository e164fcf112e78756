"""The fixtures of the folder above."""
