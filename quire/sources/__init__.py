"""Readers of inputs."""
