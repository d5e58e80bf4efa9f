"""Training-data operators: one module each, registered by ``logtide.llm.queries``."""
