"""Training-data operators over document and page tables; nothing else in the package imports this one."""
