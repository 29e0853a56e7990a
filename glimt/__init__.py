"""Telemetry analytics as lazy Spark plans: logs, spans, metrics, RUM, hosts, alerts, uptime and usage."""
